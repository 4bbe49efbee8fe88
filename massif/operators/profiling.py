"""Looking at a table before the analysis: column profiles, value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions.columns import measure
from massif.operators.bounded import settle
from massif.operators.quantiles import GROUP_ROWS, exact_percentiles
from massif.sources.tables import categorical_columns, numeric_columns

FEW_VALUES = 20


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def top_values(df: DataFrame, column: str, limit: int = FEW_VALUES) -> DataFrame:
    """The most frequent values, ties in value order."""
    return value_counts(df, column).limit(limit)


def n_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column, as (column, n_unique)."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = texts.unpivot([], list(columns), "column", "value")
    distinct = pairs.where(F.col("value").isNotNull()).distinct()
    found = distinct.groupBy("column").agg(F.count("*").alias("n_unique"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(found, "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique")
    )


def numeric_summary(df: DataFrame, exclude: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column."""
    columns = numeric_columns(df, exclude)
    wide = df.select(*[measure(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    names = F.create_map(*[F.lit(part) for i, c in enumerate(columns) for part in (f"__m{i}", c)])
    long = wide.unpivot([], [f"__m{i}" for i in range(len(columns))], "column", "value").withColumn(
        "column", F.element_at(names, F.col("column"))
    )
    moments = settle(
        long.groupBy("column").agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    largest = moments.agg(F.max("count")).first()[0] or 0
    quartiles = exact_percentiles(long, ["column"], "value", [0.25, 0.5, 0.75], largest, group_rows)
    return moments.join(quartiles, "column", "left").select(
        "column",
        "count",
        "mean",
        "std",
        "min",
        F.col("pct")[0].alias("p25"),
        F.col("pct")[1].alias("p50"),
        F.col("pct")[2].alias("p75"),
        "max",
    )


def text_summary(df: DataFrame) -> DataFrame:
    """count, distinct values, most frequent value and its rows for every text column."""
    columns = categorical_columns(df)
    counted = (
        df.select(*columns)
        .unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    return counted.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("count"),
        F.count("*").alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def profile_table(df: DataFrame, exclude: Sequence[str] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per numeric or text column: type, non-null count and its summary."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string"
    )
    parts = []
    if numeric_columns(df, exclude):
        parts.append(numeric_summary(df, exclude, group_rows))
    if categorical_columns(df):
        parts.append(text_summary(df))
    if not parts:
        return types
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return merged.join(types, "column")

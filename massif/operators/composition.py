"""What the clusters are made of: categorical counts and measure descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions.columns import measure, round_half_even
from massif.operators.bounded import settle
from massif.operators.quantiles import GROUP_ROWS, exact_percentiles
from massif.operators.segments import KEYS

CLUSTER = [*KEYS, "cluster"]
SHARES = 64


def label_rows(rows: DataFrame, comb_cluster: DataFrame) -> DataFrame:
    """Rows of a segment with the cluster of their combination."""
    return rows.join(comb_cluster, [*KEYS, "comb"])


def cluster_composition(
    combos: DataFrame, comb_cluster: DataFrame, categoricals: Sequence[str], scope: str = "all"
) -> DataFrame:
    """Rows and share of every categorical value in every cluster, zeros included.

    ``combos`` has the categorical columns, ``comb`` and its row count ``n``;
    with ``scope='segment'`` it also carries the segment keys. Working on
    combination counts keeps the rows themselves out of it.
    """
    if scope not in ("all", "segment"):
        raise ValueError("scope must be 'all' or 'segment'.")
    cats = list(categoricals)
    on = ["comb"] if scope == "all" else [*KEYS, "comb"]
    texts = combos.select(*on, "n", *[F.col(c).cast("string").alias(c) for c in cats])
    members = texts.join(comb_cluster, on)
    totals = settle(members.groupBy(*CLUSTER).agg(F.sum("n").cast("bigint").alias("total_rows")))
    counted = (
        members.unpivot([*CLUSTER, "n"], cats, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*CLUSTER, "column", "value")
        .agg(F.sum("n").cast("bigint").alias("count"))
    )
    values = texts.unpivot(["n"], cats, "column", "value").where(F.col("value").isNotNull())
    values = values.select("column", "value").distinct()
    # there are few columns: values are dealt over shares of each, so that the join has many keys
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    columns = F.explode(F.array(*[F.lit(c) for c in cats])).alias("column")
    listed = totals.select("*", columns).withColumn("share", share)
    values = values.withColumn("share", F.pmod(F.hash("value"), F.lit(SHARES)))
    spine = listed.join(values, ["column", "share"]).drop("share")
    return (
        spine.join(counted, [*CLUSTER, "column", "value"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))
        .withColumn("percentage", round_half_even(F.col("count") / F.col("total_rows") * 100, 2))
        .select(*CLUSTER, "total_rows", "column", "value", "count", "percentage")
    )


def cluster_describe(
    rows: DataFrame,
    comb_cluster: DataFrame,
    measures: Sequence[str],
    scope: str = "all",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """count, mean, std, min, quartiles, max of each measure per cluster.

    ``rows`` has ``comb`` and the measures, and ``segment_group`` when
    ``scope='segment'``. With ``scope='all'`` a cluster describes all rows of its
    combinations, in whatever group. Moments and value counts are first taken per
    combination and then merged, so rows are counted once however many segments
    there are.
    """
    if scope not in ("all", "segment"):
        raise ValueError("scope must be 'all' or 'segment'.")
    present = [m for m in measures if m in rows.columns]
    on = ["comb"] if scope == "all" else ["segment_group", "comb"]
    wide = rows.select(*on, *[measure(m).alias(f"__m{i}") for i, m in enumerate(present)])
    names = F.create_map(*[F.lit(part) for i, m in enumerate(present) for part in (f"__m{i}", m)])
    long = wide.unpivot(on, [f"__m{i}" for i in range(len(present))], "column", "value").withColumn(
        "column", F.element_at(names, F.col("column"))
    )
    per_comb = settle(
        long.groupBy(*on, "column").agg(
            F.count("value").alias("n"),
            F.avg("value").alias("m"),
            (F.var_pop("value") * F.count("value")).alias("ss"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
        )
    )
    keys = [*CLUSTER, "column"]
    members = per_comb.join(comb_cluster, on)
    moments = settle(
        members.groupBy(*keys).agg(
            F.sum("n").alias("count"),
            (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
            F.min("lo").alias("min"),
            F.max("hi").alias("max"),
        )
    )
    # squares about the cluster mean: inside the combinations plus between them
    squares = (
        members.join(moments.select(*keys, "mean"), keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("ss") + F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2))).alias("squares"))
    )
    largest = moments.agg(F.max("count")).first()[0] or 0
    quartiles = exact_percentiles(
        long, keys, "value", [0.25, 0.5, 0.75], largest, group_rows, members=comb_cluster, axis=["column"]
    )
    return (
        moments.join(squares, keys, "left")
        .join(quartiles, keys, "left")
        .select(
            *keys,
            F.col("count").cast("double").alias("count"),
            "mean",
            F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))).alias("std"),
            "min",
            F.col("pct")[0].alias("p25"),
            F.col("pct")[1].alias("p50"),
            F.col("pct")[2].alias("p75"),
            "max",
        )
    )


def composition_union(composition: DataFrame, described: DataFrame) -> DataFrame:
    """Categorical and continuous summaries in one table, absent columns null."""
    left = composition.select(
        *CLUSTER,
        F.concat_ws("_", "column", "value").alias("feature_value"),
        F.col("count").cast("double").alias("count"),
        "percentage",
    )
    return left.unionByName(described, allowMissingColumns=True)


def composition_documents(composition: DataFrame) -> DataFrame:
    """One nested row per cluster: value name -> {count, percentage}."""
    name = F.concat_ws("_", "column", "value")
    entry = F.struct(name.alias("key"), F.struct("count", "percentage").alias("value"))
    return composition.groupBy(*CLUSTER, F.col("total_rows").alias("total_rows_in_cluster")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("composition")
    )

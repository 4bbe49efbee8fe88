"""Combinations of categorical values: sizes, ids, cut-offs, row filter, one-hot."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.operators.bounded import join_null_safe, settle, stored

SMALLEST_CUTOFF = 2
#: Columns that a wide 0/1 view may have.
WIDEST = 5000


def comb_sizes(df: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Rows per distinct tuple of categoricals; null is a value of its own."""
    if not categoricals:
        return df.agg(F.count("*").alias("n"))
    return df.groupBy(*categoricals).agg(F.count("*").alias("n"))


def number_combos(sizes: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Add ``comb``: 1-based rank of the tuple in sorted order, nulls first.

    ``sizes`` has one row per tuple. The tuples are range-partitioned, written once, ranked
    within each partition and shifted by the number of tuples in the partitions before.
    """
    cats = list(categoricals)
    if not cats:
        return sizes.withColumn("comb", F.lit(1).cast("bigint"))
    ranged = stored(sizes.repartitionByRange(*cats).withColumn("part", F.spark_partition_id()), "ranged")
    parts = settle(ranged.groupBy("part").agg(F.count("*").alias("in_part")))
    before = F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local_rank = F.row_number().over(Window.partitionBy("part").orderBy(*cats))
    return (
        ranged.withColumn("local_rank", local_rank)
        .join(parts.withColumn("before", before), "part")
        .withColumn("comb", (F.col("before") + F.col("local_rank")).cast("bigint"))
        .drop("part", "in_part", "before", "local_rank")
    )


def with_comb(df: DataFrame, combos: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Attach ``comb`` to rows; rows whose tuple is not listed are dropped."""
    cats = list(categoricals)
    if not cats:
        return df.withColumn("comb", F.lit(1).cast("bigint"))
    return join_null_safe(df, combos.select(*cats, "comb"), cats)


# --- cut-offs ---------------------------------------------------------------


def size_stats(sizes: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles of the sizes.

    Distinct sizes number at most about sqrt(2 * rows), so the percentile
    buffers stay small however many combinations there are.
    """
    p = F.percentile("n", [0.10, 0.25, 0.50, 0.75, 0.90])
    return sizes.agg(
        F.count("*").alias("count"),
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"),
        F.min("n").alias("min"),
        p[0].alias("p10"),
        p[1].alias("p25"),
        p[2].alias("p50"),
        p[3].alias("p75"),
        p[4].alias("p90"),
        F.max("n").alias("max"),
    )


def percentile_cutoff(sizes: DataFrame, percent: int) -> DataFrame:
    """One row ``threshold``: the percentile of the sizes, rounded up, at least 2."""
    if not 0 <= percent <= 100:
        raise ValueError(f"A percentile cut-off lies between p0 and p100, not at p{percent}.")
    at = F.ceil(F.percentile("n", percent / 100.0)).cast("bigint")
    return sizes.agg(F.greatest(F.lit(SMALLEST_CUTOFF).cast("bigint"), at).alias("threshold"))


def knee_cutoff(sizes: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """One row ``threshold``: the size at the Kneedle knee of the falling size curve.

    The curve is a step function of rank, so it is described by its runs: one
    row per distinct size with the ranks it covers. Within a run the difference
    curve falls, hence its maxima are run starts and its minima run ends. All
    heights are multiplied by (combos - 1) * (largest - smallest), which keeps
    them whole numbers and comparisons exact.
    """
    curve = sizes.groupBy("n").agg(F.count("*").alias("members"))
    down = Window.orderBy(F.desc("n"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = lambda c: c.cast("decimal(38,0)")

    runs = (
        curve.withColumn("past", F.sum("members").over(so_far))
        .withColumn("start", F.col("past") - F.col("members"))
        .withColumn("combos", F.sum("members").over(everything))
        .withColumn("span", F.max("n").over(everything) - F.min("n").over(everything))
        .withColumn("drop", (F.max("n").over(everything) - F.col("n")))
        .withColumn(
            "d_start", whole(F.col("drop")) * whole(F.col("combos") - 1) - whole(F.col("start")) * whole(F.col("span"))
        )
        .withColumn("d_end", whole(F.col("d_start")) - whole(F.col("members") - 1) * whole(F.col("span")))
        .withColumn("d_before", F.lag("d_end").over(down))
        .withColumn("d_after", F.lead("d_start").over(down))
    )
    falls_inside = F.col("members") > 1
    rises_in = F.col("d_before").isNull() | (F.col("d_start") >= F.col("d_before"))
    drops_in = F.col("d_before").isNull() | (F.col("d_start") <= F.col("d_before"))
    rises_out = F.col("d_after").isNull() | (F.col("d_after") >= F.col("d_end"))
    drops_out = F.col("d_after").isNull() | (F.col("d_after") <= F.col("d_end"))
    walked = (
        runs.withColumn("is_peak", rises_in & (falls_inside | drops_out))
        .withColumn("is_dip", rises_out & (falls_inside | drops_in))
        .withColumn("peak_limit", F.when(F.col("is_peak"), F.col("d_start").cast("double") - sensitivity * F.col("span")))
        .withColumn("limit_out", F.when(F.col("is_dip"), F.lit(0.0)).otherwise(F.col("peak_limit")))
        .withColumn("limit_in", F.last("limit_out", ignorenulls=True).over(earlier))
        .withColumn("peak_size", F.last(F.when(F.col("is_peak"), F.col("n")), ignorenulls=True).over(so_far))
        .withColumn("limit_inside", F.coalesce("peak_limit", "limit_in"))
        .withColumn("limit_end", F.coalesce("limit_out", "limit_in"))
    )
    below = (falls_inside & (F.col("d_end").cast("double") < F.col("limit_inside"))) | (
        F.col("d_after").cast("double") < F.col("limit_end")
    )
    hit = F.col("peak_size").isNotNull() & F.coalesce(below, F.lit(False)) & (F.col("span") > 0)
    knee = walked.agg(
        F.max("combos").alias("combos"),
        F.max_by("peak_size", F.when(hit, F.col("n"))).alias("knee_size"),
        F.percentile("n", 0.25, F.col("members")).alias("p25"),
    )
    floor = F.lit(SMALLEST_CUTOFF).cast("bigint")
    return knee.select(
        F.when(F.coalesce("combos", F.lit(0)) < 3, floor)
        .when(F.col("knee_size").isNotNull(), F.greatest(floor, F.col("knee_size")))
        .otherwise(F.greatest(floor, F.ceil("p25").cast("bigint")))
        .alias("threshold")
    )


def cutoff(sizes: DataFrame | None, spec: int | str) -> int:
    """The minimum combination size for an int, ``pXX`` or ``auto-knee[(S=x)]``."""
    kind, number = parsed_cutoff(spec)
    if kind == "size":
        return number
    if sizes is None or sizes.isEmpty():
        return SMALLEST_CUTOFF
    found = percentile_cutoff(sizes, number) if kind == "percentile" else knee_cutoff(sizes, number)
    return found.first()[0]


def parsed_cutoff(spec: int | str) -> tuple[str, float]:
    """(``size``, rows), (``percentile``, percent) or (``knee``, sensitivity)."""
    if isinstance(spec, int) and not isinstance(spec, bool):
        return "size", spec
    text = str(spec).strip().lower()
    if re.fullmatch(r"p\d+", text):
        return "percentile", int(text[1:])
    if text.startswith("auto-knee"):
        return "knee", knee_sensitivity(text)
    raise ValueError(f"{spec!r} is no cut-off: a number of rows, 'p' and a whole percentile, or 'auto-knee'.")


def knee_sensitivity(spec: str) -> float:
    """The number after ``S=``; 1 where there is none."""
    found = re.search(r"s=(\d+(?:\.\d*)?|\.\d+)(?![\d.])", spec, re.IGNORECASE)
    return float(found.group(1)) if found else 1.0


# --- rows -------------------------------------------------------------------


def keep_combos(df: DataFrame, sizes: DataFrame, categoricals: Sequence[str], threshold: int) -> DataFrame:
    """Rows whose tuple has at least ``threshold`` rows.

    A semi-join to the kept tuples: the rows themselves are not shuffled when
    the list of tuples is small enough to broadcast.
    """
    kept = sizes.where(F.col("n") >= threshold)
    if not categoricals:
        return df if kept.limit(1).count() else df.limit(0)
    return join_null_safe(df, kept.select(*categoricals), list(categoricals), "left_semi")


def retention(sizes: DataFrame, threshold: int) -> DataFrame:
    """Rows kept, rows seen and the percentage, from the sizes alone."""
    kept = F.coalesce(F.sum(F.when(F.col("n") >= threshold, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(kept.alias("retained_rows"), total.alias("total_rows")).withColumn(
        "percent_retained",
        F.when(F.col("total_rows") > 0, F.col("retained_rows") * 100.0 / F.col("total_rows")).otherwise(0.0),
    )


def categorical_values(df: DataFrame, categoricals: Sequence[str]) -> DataFrame:
    """Distinct non-null (column, value) pairs, as text."""
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in categoricals]).unpivot(
        [], list(categoricals), "column", "value"
    )
    return pairs.where(F.col("value").isNotNull()).distinct()


def one_hot_long(df: DataFrame, categoricals: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ones of the 0/1 view as rows (kept columns, column, value), for any number of values.

    A null is no value, so a row of nulls has no ones.
    """
    valid = [c for c in categoricals if c in df.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in valid])
    if not valid:
        return df.select(*keep, F.lit("").alias("column"), F.lit("").alias("value")).limit(0)
    long = df.select(*keep, F.explode(entries).alias("__one"))
    return long.select(*keep, "__one.column", "__one.value").where(F.col("value").isNotNull())


def one_hot(
    df: DataFrame,
    categoricals: Sequence[str],
    grouping: str | None = None,
    measures: Sequence[str] = (),
    keep: Sequence[str] = (),
    values: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Wide 0/1 view: grouping, measures, then one column per categorical value.

    Null gives all zeros. Names come from the values, so a column whose name merely starts
    like a categorical is never mistaken for one. ``values`` lists the (column, value)
    pairs to show; without it all values found are, up to ``WIDEST`` columns. Beyond
    that ``one_hot_long`` is the form to use.
    """
    valid = [c for c in categoricals if c in df.columns]
    head = list(dict.fromkeys(c for c in [*keep, grouping, *measures] if c and c in df.columns))
    if not valid:
        return df.select(*head)
    return df.select(*[c for c in head if c not in valid], *_indicators(df, valid, values))


def one_hot_names(df: DataFrame, categoricals: Sequence[str]) -> list[str]:
    """Names of the one-hot columns, sorted."""
    valid = [c for c in categoricals if c in df.columns]
    return [name for name, _, _ in _shown_values(df, valid, None)] if valid else []


def _shown_values(df: DataFrame, valid: list[str], values: Sequence[tuple[str, str]] | None) -> list[tuple[str, str, str]]:
    """(name, column, value) of the wide columns, by name."""
    if values is None:
        found = categorical_values(df, valid).limit(WIDEST + 1).collect()
        if len(found) > WIDEST:
            raise ValueError(f"More than {WIDEST} categorical values: name the ones to show, or use the long form.")
        values = [(r["column"], r["value"]) for r in found]
    return sorted((f"{c}_{v}", c, v) for c, v in values if c in valid)


def _indicators(df: DataFrame, valid: list[str], values: Sequence[tuple[str, str]] | None):
    return [
        F.when(F.col(column).cast("string") == value, 1.0).otherwise(0.0).alias(name)
        for name, column, value in _shown_values(df, valid, values)
    ]

"""Exact percentiles of groups of any size, by one method.

The wanted order statistics of a group are bracketed: while an interval holds more than
``group_rows`` rows, a pass counts the rows inside it in equal-width buckets (a partial
aggregation, so a group of any size is spread over all tasks) and narrows it to the
bucket that holds the rank. What is left inside is ranked outright. Intervals shrink to the
values really present, so two distinct values always end up in different buckets and the
search ends at exact values. Infinite values stand at their ends: they are counted, never
bucketed.

A row belongs to one interval of an axis, named by the path of its buckets; rows and
intervals are matched by equality on axis and path.

Groups may overlap: ``members`` maps the row key to the groups it counts for. Rows are then
counted once per row key, and only those counts are spread over the groups, so a row in
many groups costs no more than a row in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.operators.bounded import settle

GROUP_ROWS = 500_000
BUCKETS = 4096
SHARED_BUCKETS = 512


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    largest: int | None = None,
    group_rows: int = GROUP_ROWS,
    buckets: int | None = None,
    members: DataFrame | None = None,
    axis: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key with ``pct``: linear-interpolated percentiles of ``value``.

    ``group_rows`` is the most rows of an interval that are ranked outright, ``largest``
    the row count of the biggest group when the caller knows it: both steer passes only.
    With ``members``, ``keys`` are its group columns, the other columns it shares
    with ``df`` are the row key, and ``axis`` names the key columns whose values
    are on one scale (they must be in ``df`` and in ``keys``).
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    if members is None:
        row_keys = axis = keys
    elif not axis:
        raise ValueError("Overlapping groups need an axis.")
    else:
        axis = list(axis)
        row_keys = axis + [c for c in members.columns if c in df.columns and c not in axis]
    number = F.col(value).cast("double")
    rows = df.select(*row_keys, number.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    spread = _Spread(members, [c for c in row_keys if members is not None and c in members.columns])
    buckets = buckets or (BUCKETS if members is None else SHARED_BUCKETS)

    finite = (F.col("v") > float("-inf")) & (F.col("v") < float("inf"))
    extent = rows.groupBy(*row_keys).agg(
        F.count("*").alias("c"),
        F.count_if(F.col("v") == float("-inf")).alias("low"),
        F.count_if(finite).alias("fin"),
        F.min(F.when(finite, F.col("v"))).alias("lo"),
        F.max(F.when(finite, F.col("v"))).alias("hi"),
    )
    extent = settle(extent)
    sizes = spread(extent).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("low").alias("low"), F.sum("fin").alias("fin"))
    sizes = settle(sizes)
    whole = extent.groupBy(*axis).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array(*[f(place(p)).cast("bigint") for p in probs for f in (F.floor, F.ceil)])
    ranked = sizes.join(whole, axis).select(*keys, "low", "fin", "lo", "hi", F.explode(F.array_distinct(ranks)).alias("rank"))
    inside = F.col("rank") - F.col("low")
    ends = F.when(inside < 0, float("-inf")).when(inside >= F.col("fin"), float("inf"))
    ranked = settle(ranked.withColumn("end", ends))
    known = [ranked.where("end IS NOT NULL").select(*keys, "rank", F.col("end").alias("at_rank"))]
    targets = settle(
        ranked.where("end IS NULL").select(
            *keys, "rank", F.lit("").alias("path"), "lo", "hi", F.col("low").alias("below"), F.col("fin").alias("inside")
        )
    )
    pool = rows.where(finite).withColumn("path", F.lit(""))
    busy = largest is None or largest > group_rows
    interval = [*axis, "path"]
    while True:
        is_open = (F.col("lo") < F.col("hi")) & (F.col("inside") > group_rows)
        known.append(targets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("at_rank")))
        known.append(_ranked(pool, targets.where(~is_open & (F.col("lo") < F.col("hi"))), keys, row_keys, interval, spread))
        if not busy or targets.where(is_open).isEmpty():
            break
        targets, pool = _narrowed(pool, targets.where(is_open), keys, row_keys, axis, spread, buckets)

    at = known[0]
    for more in known[1:]:
        at = at.unionByName(more)
    by_rank = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at_rank"))).alias("at"))

    def interpolated(p: float):
        low, high = (F.element_at("at", f(place(p)).cast("bigint")) for f in (F.floor, F.ceil))
        part = place(p) - F.floor(place(p))
        # no step between equal values, be they infinite
        return F.when((low == high) | (part == 0), low).otherwise(low + part * (high - low))

    return sizes.join(by_rank, keys).select(*keys, F.array(*[interpolated(p) for p in probs]).alias("pct"))


class _Spread:
    """Counts per row key, spread over the groups the key belongs to."""

    def __init__(self, members: DataFrame | None, on: list[str]):
        self.members, self.on = members, on

    def __call__(self, counts: DataFrame) -> DataFrame:
        return counts if self.members is None else counts.join(self.members, self.on)


def _narrowed(pool, targets, keys, row_keys, axis, spread, buckets) -> tuple[DataFrame, DataFrame]:
    """One pass: every interval is replaced by the bucket that holds the rank; the pool goes along."""
    interval = [*axis, "path"]
    in_group = list(dict.fromkeys([*keys, *interval]))
    wanted = targets.select(*interval, "lo", "hi").distinct()
    # halves keep hi - lo finite over the whole double range
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(share * buckets))).cast("int")
    dealt = pool.join(wanted, interval).withColumn("bucket", bucket)
    counted = dealt.groupBy(*row_keys, "path", "bucket").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = settle(counted)
    bounds = cells.groupBy(*interval, "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = targets.select(*in_group).distinct()
    upto = F.sum("c").over(Window.partitionBy(*in_group).orderBy("bucket"))
    stacked = spread(cells.drop("lo", "hi")).join(groups, in_group, "left_semi").groupBy(*in_group, "bucket").agg(F.sum("c").alias("c"))
    stacked = stacked.withColumn("upto", upto)
    from_, to = F.col("below") + F.col("upto") - F.col("c"), F.col("below") + F.col("upto")
    deeper = F.concat_ws("/", "path", "bucket")
    found = (
        targets.drop("lo", "hi", "inside")
        .join(stacked, in_group)
        .where((F.col("rank") >= from_) & (F.col("rank") < to))
        .join(bounds, [*interval, "bucket"])
        .select(*keys, "rank", deeper.alias("path"), "lo", "hi", from_.alias("below"), F.col("c").alias("inside"))
    )
    return settle(found), dealt.select(*row_keys, "v", deeper.alias("path"))


def _ranked(pool, targets, keys, row_keys, interval, spread) -> DataFrame:
    """The values at the ranks of intervals with few rows, by ranking what is inside."""
    in_group = list(dict.fromkeys([*keys, *interval]))
    groups = targets.select(*in_group).distinct()
    if spread.members is None:
        wanted = groups.select(*interval).distinct()
    else:  # only the row keys of groups that ask
        wanted = groups.join(spread.members, [c for c in groups.columns if c in spread.members.columns]).select(*dict.fromkeys([*row_keys, "path"])).distinct()
    valued = pool.join(wanted, wanted.columns).groupBy(*row_keys, "path", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*in_group).orderBy("v"))
    stacked = spread(valued).join(groups, in_group, "left_semi").groupBy(*in_group, "v").agg(F.sum("c").alias("c")).withColumn("upto", upto)
    return (
        targets.drop("lo", "hi", "inside")
        .join(stacked, in_group)
        .where(F.col("rank") < F.col("below") + F.col("upto"))
        .groupBy(*keys, "rank")
        .agg(F.min("v").alias("at_rank"))
    )

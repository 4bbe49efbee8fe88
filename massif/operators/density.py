"""High-density regions, density histograms and box summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.columns import display_name, published_edge
from massif.operators.binning import quantize
from massif.operators.bounded import settle
from massif.operators.quantiles import GROUP_ROWS, exact_percentiles
from massif.operators.segments import KEYS

SMALLEST_HDR_COUNT = 2


def high_density_region(profile: DataFrame, params: DataFrame, excluded_percent: float) -> DataFrame:
    """The heaviest contiguous block of bins above the cluster's density level.

    ``excluded_percent`` is the share of the mass left out. The level is the
    highest whole y whose excess mass ``sum(max(n - y, 0))`` still reaches the
    target. With S_m the sum of the m largest counts that excess is
    ``max_m(S_m - m * y)``, so the level is ``floor(max_m((S_m - target) / m))``:
    one sort per cluster, no search.

    ``profile`` holds (segment, cluster, bin, n). The result has one row per
    cluster; the interval columns are null when there is no region.
    """
    cluster = [*KEYS, "cluster"]
    per_cluster = Window.partitionBy(*cluster)
    falling = per_cluster.orderBy(F.desc("n"), "bin")
    running = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leveled = (
        profile.where(F.col("bin").isNotNull())
        .withColumn("total", F.sum("n").over(per_cluster).cast("double"))
        .withColumn("target", F.col("total") * F.lit(100.0 - excluded_percent) / 100.0)
        .withColumn("excess", (F.sum("n").over(running) - F.col("target")) / F.row_number().over(falling))
        .withColumn(
            "level",
            F.when(F.col("total") == 0, F.lit(0.0))
            .when(F.col("target") <= 0, F.max("n").over(per_cluster).cast("double") + 1)
            .otherwise(F.floor(F.max("excess").over(per_cluster)).cast("double")),
        )
    )
    above = F.col("n") > F.col("level")
    # consecutive bins above the level share the number of bins above minus the bin
    rank_above = F.sum(above.cast("int")).over(
        per_cluster.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = (
        leveled.withColumn("block", F.when(above, F.col("bin") - rank_above))
        .groupBy(*cluster, "level", "block")
        .agg(
            F.min("bin").alias("start_bin"),
            F.max("bin").alias("end_bin"),
            F.sum("n").alias("mass"),
            F.max("n").alias("peak_count"),
            F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("peak_bin"),
        )
    )
    found = F.struct("start_bin", "end_bin", "peak_bin", "mass", "peak_count")
    heaviest = F.when(F.col("block").isNotNull(), F.struct(-F.col("mass"), F.col("start_bin")))
    mass_above = F.sum(F.when(F.col("block").isNotNull(), F.col("mass")))
    best = (
        blocks.groupBy(*cluster)
        .agg(F.first("level").alias("level"), F.min_by(found, heaviest).alias("b"), mass_above.alias("mass_above"))
        .join(params.select(*KEYS, "mn", "mx", "n_bins", "unit"), KEYS)
        .withColumn(
            "b", F.when((F.col("mass_above") >= SMALLEST_HDR_COUNT) & (F.col("b.end_bin") <= F.col("n_bins")), F.col("b"))
        )
    )
    edge = lambda i: published_edge(i, F.col("mn"), F.col("mx"), F.col("n_bins"))
    start, end, peak = F.col("b.start_bin"), F.col("b.end_bin"), F.col("b.peak_bin")
    has_region = F.col("b").isNotNull()
    return best.select(
        *cluster,
        F.col("level").alias("hdr_threshold_count"),
        start,
        end,
        ((start + end) / 2.0).alias("median_bin"),
        peak,
        F.when(has_region, edge(start - 1)).alias("start_edge"),
        F.when(has_region, edge(end)).alias("end_edge"),
        F.when(has_region, (edge(peak - 1) + edge(peak)) / 2.0).alias("most_probable"),
        F.when(has_region, F.col("unit")).alias("unit"),
        F.col("b.mass").cast("double").alias("mass"),
        F.col("b.peak_count").cast("double").alias("peak_count"),
    )


def hdr_profile(regions: DataFrame) -> DataFrame:
    """The regions as one struct column, with an interval list of length 0 or 1."""
    interval = F.struct(
        F.col("start_bin").alias("start_bin_label"),
        F.col("end_bin").alias("end_bin_label"),
        F.col("median_bin").alias("median_bin_label"),
        F.col("peak_bin").alias("peak_bin_label"),
        F.col("start_edge").alias("start_edge_orig_unit"),
        F.col("end_edge").alias("end_edge_orig_unit"),
        F.col("most_probable").alias("most_probable_orig_unit"),
        F.col("unit"),
        F.col("mass").alias("total_mass_in_interval"),
        F.col("peak_count"),
    )
    listed = F.filter(F.array(F.when(F.col("start_bin").isNotNull(), interval)), lambda i: i.isNotNull())
    return regions.select(
        *KEYS, "cluster", F.struct(F.col("hdr_threshold_count"), listed.alias("hdr_intervals")).alias("hdr_profile")
    )


def density_histogram(
    long: DataFrame,
    stats: DataFrame,
    params: DataFrame,
    group_names: Mapping[str, str] | None = None,
    feature_names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Probability density per (segment, bin) with n per group.

    A segment that cannot be cut keeps one row: flagged as without data when it
    has no value, with a null bin and density otherwise.
    """
    valued = long.where(F.col("value").isNotNull())
    counted = quantize(valued, params).groupBy(*KEYS, "bin").agg(F.count("*").alias("c"))
    width = (F.col("mx") - F.col("mn")) / F.col("n_bins")
    bars = counted.join(params.select(*KEYS, "n", "mn", "mx", "n_bins"), KEYS).select(
        *KEYS, "bin", F.col("c").alias("count"), (F.col("c") / (F.col("n") * width)).alias("density")
    )
    return (
        stats.select(*KEYS, F.col("rows").alias("group_rows"), (F.col("n") > 0).alias("has_data"))
        .join(bars, KEYS, "left")
        .withColumn("group_name", display_name(F.col("segment_group"), group_names))
        .withColumn("feature_name", display_name(F.col("feature"), feature_names))
    )


def box_stats(
    df: DataFrame, keys: Sequence[str], value: str, group_rows: int = GROUP_ROWS, largest: int | None = None
) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 IQR of them."""
    keys = list(keys)
    quartiles = settle(
        exact_percentiles(df, keys, value, [0.25, 0.5, 0.75], largest, group_rows).select(
            *keys,
            F.col("pct")[0].alias("q25"),
            F.col("pct")[1].alias("median"),
            F.col("pct")[2].alias("q75"),
        )
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        df.join(quartiles, keys)
        .groupBy(*keys, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.when(~inside, F.col(value))).alias("outliers"),
        )
    )

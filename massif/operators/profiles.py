"""Histogram profiles of combinations and clusters, as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.columns import axis_struct, segment_name
from massif.operators.combos import WIDEST
from massif.operators.segments import KEYS


def comb_profile(binned: DataFrame, comb: Sequence[str] = ("comb",)) -> DataFrame:
    """Rows per (segment, combination, bin).

    Rows without a measure are counted under a null bin, so a combination that
    has only such rows keeps its (empty) histogram.
    """
    return binned.groupBy(*KEYS, *comb, "bin").agg(F.count("*").alias("n"))


def cluster_profile(profile: DataFrame) -> DataFrame:
    """Sum of the combination profiles per cluster; needs a ``cluster`` column."""
    return (
        profile.where(F.col("bin").isNotNull())
        .groupBy(*KEYS, "cluster", "bin")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def run_profile(profile: DataFrame, params: DataFrame) -> DataFrame:
    """The whole bin axis of every cluster as runs: (first_bin, last_bin, n), n for each bin of the run.

    A counted bin is a run of its own, a stretch of empty bins is one run, so there are at most
    about twice as many rows as counted bins, however many bins the axis has.
    """
    counted = profile.where(F.col("bin").isNotNull()).join(params.select(*KEYS, "n_bins"), KEYS)
    along = Window.partitionBy(*KEYS, "cluster").orderBy("bin")
    first, last, none = F.lit(1).cast("bigint"), F.col("n_bins").cast("bigint"), F.lit(0).cast("bigint")
    bin_ = F.col("bin").cast("bigint")

    def run(start: Column, end: Column, n: Column) -> Column:
        return F.when(start <= end, F.struct(start.alias("first_bin"), end.alias("last_bin"), n.cast("bigint").alias("n")))

    before = run(F.coalesce(F.lag(bin_).over(along) + 1, first), bin_ - 1, none)
    after = F.when(F.lead(bin_).over(along).isNull(), run(bin_ + 1, last, none))
    runs = F.filter(F.array(before, run(bin_, bin_, F.col("n")), after), lambda r: r.isNotNull())
    return counted.select(*KEYS, "cluster", runs.alias("runs")).select(*KEYS, "cluster", F.explode("runs").alias("r")).select(*KEYS, "cluster", "r.*")


def dense_profile(profile: DataFrame, params: DataFrame) -> DataFrame:
    """Every bin 1..n_bins of every cluster, zero where nothing was counted; a view of axes that are short enough to be listed."""
    bins = F.explode(F.sequence("first_bin", "last_bin")).alias("bin")
    return run_profile(profile, params).select(*KEYS, "cluster", bins, "n")


def profile_share(profile: DataFrame) -> DataFrame:
    """Count, cluster total and percentage per bin, of bins or of runs; 0 where the total is 0."""
    total = F.sum("n").over(Window.partitionBy(*KEYS, "cluster"))
    return profile.withColumn("total_items", total).withColumn(
        "percentage", F.when(F.col("total_items") > 0, F.col("n") * 100.0 / F.col("total_items")).otherwise(0.0)
    )


def wide_profile(profile: DataFrame, n_bins: int, comb: Sequence[str] = ("cluster",)) -> DataFrame:
    """One row per cluster with columns c_1..c_n; a view for display, of at most ``WIDEST`` bins."""
    if n_bins > WIDEST:
        raise ValueError(f"A wide view of {n_bins} bins has too many columns; use the long profile.")
    pivoted = profile.groupBy(*KEYS, *comb).pivot("bin", list(range(1, n_bins + 1))).agg(F.sum("n"))
    return pivoted.select(
        *KEYS, *comb, *[F.coalesce(F.col(str(i)), F.lit(0)).cast("double").alias(f"c_{i}") for i in range(1, n_bins + 1)]
    )


def unpivot_profile(wide: DataFrame, ids: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """Wide to long; ``class_num`` is the number in the column name."""
    return wide.unpivot(list(ids), list(bins), "classes", "count").withColumn(
        "class_num", F.regexp_extract("classes", r"(\d+)$", 1).try_cast("int")
    )


def profile_documents(
    runs: DataFrame, params: DataFrame, hdr: DataFrame, optimal_k: DataFrame
) -> DataFrame:
    """One nested row per segment: its axis, and per cluster its bins as runs and its HDR.

    All edges follow from ``axis``; ``count`` and ``percentage_of_cluster`` are those of each bin of a run.
    """
    bins = (
        profile_share(runs)
        .groupBy(*KEYS, "cluster")
        .agg(
            F.sum("n").cast("double").alias("total_items"),
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "first_bin",
                        "last_bin",
                        F.col("n").cast("double").alias("count"),
                        F.col("percentage").alias("percentage_of_cluster"),
                    )
                )
            ).alias("bin_profiles"),
        )
    )
    clusters = (
        bins.join(hdr.select(*KEYS, "cluster", "hdr_profile"), [*KEYS, "cluster"], "left")
        .groupBy(*KEYS)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("cluster").alias("cluster_id"), "total_items", "hdr_profile", "bin_profiles")
                )
            ).alias("clusters")
        )
    )
    return (
        clusters.join(params, KEYS)
        .join(optimal_k, KEYS, "left")
        .select(
            segment_name(F.col("segment_group"), F.col("feature")).alias("segment_name"),
            *KEYS,
            F.coalesce("k", F.lit(0)).alias("optimal_k_used"),
            F.col("n_bins").alias("quantization_bins"),
            axis_struct(F.col("mn"), F.col("mx"), F.col("n_bins")).alias("axis"),
            "unit",
            "clusters",
        )
    )

"""Choosing the number of clusters from silhouette scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.columns import round_half_even
from massif.operators.segments import KEYS


def from_first_peak(scores: DataFrame, keys: Sequence[str] = KEYS, score: str = "silhouette") -> DataFrame:
    """Scores from the smallest k whose score, to two digits, is the best.

    Halves round to even, as in numpy. Missing scores are dropped.
    """
    per_key = Window.partitionBy(*keys)
    valid = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn(
        "__rounded", round_half_even(F.col(score), 2)
    )
    top = valid.withColumn("__best", F.max("__rounded").over(per_key)).withColumn(
        "__peak", F.min(F.when(F.col("__rounded") == F.col("__best"), F.col("k"))).over(per_key)
    )
    return top.where(F.col("k") >= F.col("__peak")).drop("__rounded", "__best", "__peak")


def optimal_k(
    scores: DataFrame, max_relative_drop: float, keys: Sequence[str] = KEYS, score: str = "silhouette"
) -> DataFrame:
    """The last k reached before the first relative drop above the limit."""
    rising = Window.partitionBy(*keys).orderBy("k")
    previous = F.lag(score).over(rising)
    drop = F.when(previous != 0, (previous - F.col(score)) / F.abs(previous)).otherwise(
        F.when(F.col(score) < 0, 1.0).otherwise(0.0)
    )
    stop = (previous.isNotNull() & (drop > max_relative_drop)).cast("int")
    stopped = F.max("__stop").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        scores.withColumn("__stop", stop)
        .withColumn("__stopped", stopped)
        .where("__stopped = 0")
        .groupBy(*keys)
        .agg(F.max("k").alias("k"))
    )


def elbow(scores: DataFrame, current_k: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Defined (k, WCSS) points with the chosen k flagged."""
    chosen = current_k.select(*keys, F.col("k").alias("chosen_k"))
    return (
        scores.where(F.col("wcss").isNotNull() & ~F.isnan("wcss"))
        .join(chosen, list(keys), "left")
        .select(*keys, "k", "wcss", F.coalesce(F.col("k") == F.col("chosen_k"), F.lit(False)).alias("is_current"))
    )

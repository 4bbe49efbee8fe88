"""Euclidean silhouette of histogram clusterings.

The mean distance of a point to every cluster needs all distances, so the work
is quadratic in combinations. It is cut into square tiles of bounded size: each
combination goes to a block, each pair of blocks is one tile and one task input,
and a tile returns only distance sums per (combination, cluster). Pairs are
never emitted, and a segment with very many combinations simply has more tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.operators.bounded import settle
from massif.operators.segments import KEYS

BLOCK = 2048
BIN_CHUNK = 4096

TILE_SCHEMA = "segment_group string, feature string, comb bigint, k int, cluster int, other int, dist_sum double"


class Cells:
    """The filled cells of some histograms, sorted by bin, to be laid out chunk by chunk."""

    def __init__(self, pdf: pd.DataFrame):
        self.rows = len(pdf)
        lengths = [len(b) for b in pdf["bins"]]
        bins = np.concatenate([np.asarray(b, dtype=np.int64) for b in pdf["bins"]] + [np.empty(0, np.int64)])
        counts = np.concatenate([np.asarray(c, dtype=float) for c in pdf["counts"]] + [np.empty(0)])
        order = np.argsort(bins, kind="stable")
        self.bins, self.counts = bins[order], counts[order]
        self.row = np.repeat(np.arange(self.rows), lengths)[order]

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """Rows x columns for an ascending run of bins."""
        matrix = np.zeros((self.rows, len(columns)))
        if len(columns):
            low, high = np.searchsorted(self.bins, [columns[0], columns[-1] + 1])
            at = np.searchsorted(columns, self.bins[low:high])
            here = columns[at] == self.bins[low:high]
            matrix[self.row[low:high][here], at[here]] = self.counts[low:high][here]
        return matrix


def _tile_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    group, feature, low, high = key
    sides = [pdf[pdf["block"] == low], pdf[pdf["block"] == high]]
    cells = [Cells(side) for side in sides]
    # only bins filled on both sides add to the dot products
    shared = np.intersect1d(cells[0].bins, cells[1].bins)
    dots = np.zeros((len(sides[0]), len(sides[1])))
    for start in range(0, len(shared), BIN_CHUNK):
        chunk = shared[start : start + BIN_CHUNK]
        dots += cells[0].dense(chunk) @ cells[1].dense(chunk).T
    norms = [side["norm"].to_numpy() for side in sides]
    square = norms[0][:, None] + norms[1][None, :]
    apart = np.maximum(square - 2.0 * dots, 0.0)
    # nearly equal histograms: the difference of large numbers is taken again from the counts
    for i, j in zip(*np.nonzero(apart < square * 1e-6), strict=True):
        apart[i, j] = _square_distance(sides[0].iloc[i], sides[1].iloc[j])
    distance = np.sqrt(apart)
    parts = [_sums_by_cluster(sides[0], sides[1], distance)]
    if low != high:
        parts.append(_sums_by_cluster(sides[1], sides[0], distance.T))
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "feature", feature)
    out.insert(0, "segment_group", group)
    return out


def _square_distance(one: pd.Series, other: pd.Series) -> float:
    """Squared distance of two histograms from the differences of their counts."""
    bins = np.concatenate([one["bins"], other["bins"]]).astype(np.int64)
    counts = np.concatenate([one["counts"], -np.asarray(other["counts"], dtype=float)])
    _, at = np.unique(bins, return_inverse=True)
    return float((np.bincount(at, counts) ** 2).sum()) if len(bins) else 0.0


def _sums_by_cluster(rows: pd.DataFrame, others: pd.DataFrame, distance: np.ndarray) -> pd.DataFrame:
    if not len(rows) or not len(others):
        return pd.DataFrame({"comb": [], "k": [], "cluster": [], "other": [], "dist_sum": []})
    ks = np.asarray(others["ks"].iloc[0])
    own = np.array(rows["clusters"].tolist())
    labels = np.array(others["clusters"].tolist())
    parts = []
    for position, k in enumerate(ks):
        found, codes = np.unique(labels[:, position], return_inverse=True)
        sums = distance @ np.eye(len(found))[codes]
        parts.append(
            pd.DataFrame(
                {
                    "comb": np.repeat(rows["comb"].to_numpy(), len(found)),
                    "k": int(k),
                    "cluster": np.repeat(own[:, position], len(found)),
                    "other": np.tile(found, len(rows)),
                    "dist_sum": sums.ravel(),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Combinations per (segment, k, cluster)."""
    return settle(labels.groupBy(*KEYS, "k", "cluster").agg(F.count("*").alias("size")))


def distance_sums(profile: DataFrame, labels: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distances summed per tile, from each combination to each cluster, for every k.

    ``profile`` is (segment, comb, bin, n) with null bins allowed, ``labels`` is
    (segment, comb, k, cluster) with the same k values for all combinations of a
    segment.
    """
    order = F.array_sort(F.collect_list(F.struct("k", "cluster")))
    labeled = labels.groupBy(*KEYS, "comb").agg(order.alias("l"))
    filled = profile.where(F.col("bin").isNotNull())
    histograms = filled.groupBy(*KEYS, "comb").agg(
        F.collect_list(F.struct("bin", F.col("n").cast("double").alias("n"))).alias("h"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("norm"),
    )
    combos = F.sum("size") / F.countDistinct("k")
    blocks = sizes.groupBy(*KEYS).agg(F.ceil(combos / F.lit(block)).cast("int").alias("n_blocks"))
    points = (
        labeled.join(histograms, [*KEYS, "comb"], "left")
        .join(blocks, KEYS)
        .select(
            *KEYS,
            "comb",
            F.pmod(F.xxhash64("comb"), F.col("n_blocks")).cast("int").alias("block"),
            "n_blocks",
            F.col("l.k").alias("ks"),
            F.col("l.cluster").alias("clusters"),
            F.coalesce("h.bin", F.array().cast("array<int>")).alias("bins"),
            F.coalesce("h.n", F.array().cast("array<double>")).alias("counts"),
            F.coalesce("norm", F.lit(0.0)).alias("norm"),
        )
    )
    tiled = points.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        *KEYS,
        F.least("block", "facing").alias("low"),
        F.greatest("block", "facing").alias("high"),
        "comb",
        "block",
        "ks",
        "clusters",
        "bins",
        "counts",
        "norm",
    )
    return tiled.groupBy(*KEYS, "low", "high").applyInPandas(_tile_sums, TILE_SCHEMA)


def squared_distance_sums(profile: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Squared distances summed from each combination to each cluster, for every k, without pairs.

    The sum over a cluster needs its number of members, the sum of their norms and the sum of
    their histograms, so the work grows with the cells and the clusters.
    """
    one_k = [*KEYS, "k"]
    cells = profile.where(F.col("bin").isNotNull()).select(*KEYS, "comb", "bin", F.col("n").cast("double").alias("n"))
    norms = cells.groupBy(*KEYS, "comb").agg(F.sum(F.col("n") * F.col("n")).alias("norm"))
    normed = labels.join(norms, [*KEYS, "comb"], "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    normed = settle(normed.select(*one_k, "comb", "cluster", "norm"))
    spread = normed.groupBy(*one_k, F.col("cluster").alias("other")).agg(F.sum("norm").alias("norms"))
    totals = labels.join(cells, [*KEYS, "comb"]).groupBy(*one_k, F.col("cluster").alias("other"), "bin").agg(F.sum("n").alias("s"))
    dots = cells.join(totals, [*KEYS, "bin"]).groupBy(*one_k, "comb", "other").agg(F.sum(F.col("n") * F.col("s")).alias("dot"))
    facing = sizes.select(*one_k, F.col("cluster").alias("other"), "size").join(spread, [*one_k, "other"])
    sums = normed.join(facing, one_k).join(dots, [*one_k, "comb", "other"], "left")
    apart = F.col("size") * F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("norms")
    return sums.select(*one_k, "comb", "cluster", "other", F.greatest(apart, F.lit(0.0)).alias("dist_sum"))


def silhouette_samples(
    profile: DataFrame, labels: DataFrame, block: int = BLOCK, sizes: DataFrame | None = None, metric: str = "euclidean"
) -> DataFrame:
    """Silhouette coefficient per (segment, k, combination); 0 for a lone member.

    ``metric`` is ``euclidean``, which needs all pairs, or ``squared_euclidean``, which is linear.
    """
    if metric not in ("euclidean", "squared_euclidean"):
        raise ValueError(f"metric is 'euclidean' or 'squared_euclidean', not {metric!r}.")
    sizes = cluster_sizes(labels) if sizes is None else sizes
    apart = distance_sums(profile, labels, sizes, block) if metric == "euclidean" else squared_distance_sums(profile, labels, sizes)
    own = sizes.select(*KEYS, "k", "cluster", "size")
    others = sizes.select(*KEYS, "k", F.col("cluster").alias("other"), F.col("size").alias("other_size"))
    sample = [*KEYS, "k", "comb"]
    # one shuffle serves both the sum over tiles and the choice among clusters
    sums = (
        apart.repartition(*sample)
        .groupBy(*sample, "cluster", "other")
        .agg(F.sum("dist_sum").alias("dist_sum"))
        .join(own, [*KEYS, "k", "cluster"])
        .join(others, [*KEYS, "k", "other"])
    )
    at_home = F.col("other") == F.col("cluster")
    measured = sums.groupBy(*sample, "cluster", "size").agg(
        F.max(F.when(at_home & (F.col("size") > 1), F.col("dist_sum") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~at_home, F.col("dist_sum") / F.col("other_size"))).alias("b"),
    )
    worst = F.greatest("a", "b")
    coefficient = (
        F.when(F.col("b").isNull(), F.lit(None))
        .when((F.col("size") == 1) | (worst == 0), F.lit(0.0))
        .otherwise((F.col("b") - F.col("a")) / worst)
    )
    return measured.select(*KEYS, "k", "comb", "cluster", coefficient.cast("double").alias("silhouette"))


def silhouette_scores(
    profile: DataFrame, labels: DataFrame, block: int = BLOCK, sizes: DataFrame | None = None, metric: str = "euclidean"
) -> DataFrame:
    """Mean silhouette per (segment, k); null unless 1 < clusters < combinations."""
    sizes = cluster_sizes(labels) if sizes is None else sizes
    samples = silhouette_samples(profile, labels, block, sizes, metric)
    scored = samples.groupBy(*KEYS, "k").agg(F.avg("silhouette").alias("silhouette"))
    counts = sizes.groupBy(*KEYS, "k").agg(F.count("*").alias("clusters"), F.sum("size").alias("combos"))
    valid = (F.col("clusters") > 1) & (F.col("clusters") < F.col("combos"))
    return scored.join(counts, [*KEYS, "k"]).select(
        *KEYS, "k", F.when(valid, F.col("silhouette")).alias("silhouette")
    )


def order_samples(samples: DataFrame) -> DataFrame:
    """Stacked chart positions: clusters in order, coefficients rising inside each.

    ``position`` runs over the whole (segment, k), from 0. It is the rank inside
    the cluster plus the size of the clusters before it. Coefficients equal to
    nine digits are ties, so the order does not hang on the order of summation.
    """
    one_k = [*KEYS, "k"]
    rising = Window.partitionBy(*one_k, "cluster").orderBy(F.round("silhouette", 9), "comb")
    inside = F.row_number().over(rising)
    before = F.sum("size").over(Window.partitionBy(*one_k).orderBy("cluster")) - F.col("size")
    starts = settle(
        samples.groupBy(*one_k, "cluster").agg(F.count("*").alias("size")).withColumn("first_position", before)
    )
    return (
        samples.withColumn("rank_in_cluster", inside)
        .join(starts, [*one_k, "cluster"])
        .withColumn("position", F.col("first_position") + F.col("rank_in_cluster") - 1)
        .drop("size", "first_position")
    )

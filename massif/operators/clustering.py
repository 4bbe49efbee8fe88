"""K-Means over combination histograms, one model per (segment, k)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.operators.bounded import settle
from massif.operators.segments import KEYS
from massif.operators.silhouette import BLOCK, cluster_sizes, silhouette_scores
from massif.session import scratch_path

SEED = 10
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
CELLS_PER_PARTITION = 1_000_000
#: Directions carried by the projection, and how often they are multiplied by the histograms.
DIRECTIONS = 6
PASSES = 10

LABEL_SCHEMA = "segment_group string, feature string, k int, comb bigint, cluster int"
POINT_SCHEMA = "segment_group string, feature string, comb bigint, pc1 double, pc2 double"


@dataclass(frozen=True)
class SegmentVectors:
    """One row of the driver-side list of segments with stored histograms."""

    segment_id: int
    segment_group: str
    feature: str
    n_bins: int
    combos: int
    cells: int


class OneCluster:
    """The model of a single cluster: its centre is the mean of the rows."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as the models of Spark
        return [self.centre]

    def transform(self, features: DataFrame) -> DataFrame:
        return features.withColumn("prediction", F.lit(0))


def fit_kmeans(features: DataFrame, k: int, rows: int | None = None, seed: int = SEED) -> KMeansModel | OneCluster:
    """Fit K-Means on a ``features`` vector column with a fixed seed."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k has to be a whole number from 1 on, not {k!r}.")
    rows = features.count() if rows is None else rows
    if rows == 0:
        raise ValueError("There are no rows to fit clusters to.")
    if k > rows:
        raise ValueError(f"{rows} rows cannot be divided into k={k} clusters.")
    if k == 1:
        return OneCluster(features.select(Summarizer.mean(F.col("features"))).first()[0].toArray())
    return KMeans(k=k, seed=seed, maxIter=MAX_ITERATIONS, tol=TOLERANCE).fit(features)


def k_range(min_k: int, max_k: int, combos: int) -> range:
    """Tested cluster numbers: at least 2, at most one less than the combinations."""
    return range(max(2, min_k), min(max_k, combos - 1) + 1)


def store_vectors(profile: DataFrame, params: DataFrame) -> tuple[str, Iterator[SegmentVectors]]:
    """Write the sparse histogram of each (segment, comb), one folder per segment.

    The struct written is the storage form of an ML vector, so reading it back
    with a vector schema needs no conversion per row. The segments come one by one.
    """
    # bins that no combination fills do not change a distance: a vector has one place per counted bin
    counted = profile.where(F.col("bin").isNotNull()).select(*KEYS, "bin").distinct()
    places = counted.withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("bin")) - 1)
    places = settle(places)
    widths = places.groupBy(*KEYS).agg(F.count("*").cast("int").alias("n_bins"))
    numbered = settle(
        params.select(*KEYS).join(widths, KEYS).withColumn("segment_id", F.row_number().over(Window.orderBy(*KEYS)).cast("int"))
    )
    cell = F.when(F.col("i").isNotNull(), F.struct("i", F.col("n").cast("double").alias("v")))
    vectors = (
        profile.join(places, [*KEYS, "bin"], "left")
        .groupBy(*KEYS, "comb")
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        .join(numbered, KEYS)
        .select(
            "segment_id",
            "comb",
            F.struct(
                F.lit(0).cast("tinyint").alias("type"),
                F.col("n_bins").cast("int").alias("size"),
                F.col("cells.i").cast("array<int>").alias("indices"),
                F.col("cells.v").alias("values"),
            ).alias("features"),
        )
    )
    path = scratch_path(profile.sparkSession, "histograms")
    vectors.write.partitionBy("segment_id").parquet(path)
    counts = (
        profile.groupBy(*KEYS)
        .agg(F.countDistinct("comb").alias("combos"), F.count("*").alias("cells"))
        .join(numbered, KEYS)
    )
    listed = settle(counts).orderBy("segment_id").toLocalIterator()
    return path, (SegmentVectors(r.segment_id, r.segment_group, r.feature, r.n_bins, r.combos, r.cells) for r in listed)


def read_vectors(spark: SparkSession, path: str, segment: SegmentVectors) -> DataFrame:
    """The stored histograms of one segment, in a repeatable partitioning and order."""
    schema = T.StructType(
        [
            T.StructField("comb", T.LongType()),
            T.StructField("features", VectorUDT()),
            T.StructField("segment_id", T.IntegerType()),
        ]
    )
    parts = max(1, math.ceil(segment.cells / CELLS_PER_PARTITION))
    return (
        spark.read.schema(schema)
        .parquet(path)
        .where(F.col("segment_id") == segment.segment_id)
        .select("comb", "features")
        .repartition(parts, "comb")
        .sortWithinPartitions("comb")
    )


def sweep_labels(
    profile: DataFrame, params: DataFrame, min_k: int, max_k: int, threads: int = 8, seed: int = SEED
) -> DataFrame:
    """Cluster labels (segment, k, comb, cluster) for every k in range of every segment.

    Every fit is a Spark ML job over the stored histograms, whatever the size of the segment.
    A few are submitted at a time; only their segments are held in memory, and
    each writes its labels, so no label passes through the driver.
    """
    spark = profile.sparkSession
    path, segments = store_vectors(profile, params)
    out = scratch_path(spark, "labels")

    def fit(task: tuple[SegmentVectors, DataFrame, int]) -> None:
        segment, frame, k = task
        fit_kmeans(frame, k, segment.combos, seed).transform(frame).select(
            F.lit(segment.segment_group).alias("segment_group"),
            F.lit(segment.feature).alias("feature"),
            F.lit(k).alias("k"),
            "comb",
            F.col("prediction").alias("cluster"),
        ).write.parquet(f"{out}/part-{segment.segment_id}-{k}")

    fitted = 0
    with ThreadPoolExecutor(max_workers=threads) as pool:
        while some := list(islice(segments, threads)):
            frames = [(s, read_vectors(spark, path, s).persist()) for s in some]
            try:
                fitted += len(list(pool.map(fit, [(s, frame, k) for s, frame in frames for k in k_range(min_k, max_k, s.combos)])))
            finally:
                for _, frame in frames:
                    frame.unpersist()
    if not fitted:
        return spark.createDataFrame([], LABEL_SCHEMA)
    return spark.read.schema(LABEL_SCHEMA).parquet(f"{out}/part-*")


def within_cluster_ss(profile: DataFrame, labels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """WCSS per (segment, k) from labels: sum of squares less the clusters' share."""
    one_k = [*KEYS, "k"]
    sizes = cluster_sizes(labels) if sizes is None else sizes
    cells = labels.join(profile.where(F.col("bin").isNotNull()), [*KEYS, "comb"], "left")
    by_bin = cells.groupBy(*one_k, "cluster", "bin").agg(
        F.sum("n").cast("double").alias("s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s2")
    )
    return (
        by_bin.join(sizes, [*one_k, "cluster"])
        .groupBy(*one_k)
        .agg(F.sum(F.coalesce(F.col("s2") - F.col("s") * F.col("s") / F.col("size"), F.lit(0.0))).alias("wcss"))
    )


def k_scores(profile: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """WCSS and mean silhouette per (segment, k)."""
    sizes = cluster_sizes(labels)
    scores = silhouette_scores(profile, labels, block, sizes)
    return within_cluster_ss(profile, labels, sizes).join(scores, [*KEYS, "k"], "left")


def final_clusters(profile: DataFrame, labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cluster of each combination at the chosen k, clusters numbered from 0.

    Numbers follow the mean bin of the cluster, so they do not depend on the
    order in which K-Means happened to seed its centres.
    """
    at_k = labels.join(chosen.select(*KEYS, "k"), [*KEYS, "k"]).select(*KEYS, "comb", F.col("cluster").alias("raw"))
    centre = (
        at_k.join(profile.where(F.col("bin").isNotNull()), [*KEYS, "comb"], "left")
        .groupBy(*KEYS, "raw")
        .agg((F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("mean_bin"), F.min("comb").alias("first_comb"))
    )
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.asc_nulls_last("mean_bin"), "first_comb")) - 1
    numbers = settle(centre.withColumn("cluster", number.cast("int")).select(*KEYS, "raw", "cluster"))
    return at_k.join(numbers, [*KEYS, "raw"]).select(*KEYS, "comb", "cluster")


def project_2d(profile: DataFrame, params: DataFrame, labels: DataFrame) -> DataFrame:
    """First two principal components of the histograms and of the cluster centres.

    Signs are fixed so that the largest loading of a component is positive; a component
    without variance is 0. Segments with fewer than two bins or combinations have no projection.
    ``labels`` is (segment, comb, cluster); a centre is the mean of its members.
    """
    sizes = profile.groupBy(*KEYS).agg(F.countDistinct("comb").alias("combos"))
    wanted = sizes.join(params.where("n_bins > 1").select(*KEYS), KEYS).where("combos > 1")
    points = _components(profile.join(wanted.select(*KEYS), KEYS, "left_semi"))
    members = points.join(labels.select(*KEYS, "comb", "cluster"), [*KEYS, "comb"])
    centres = members.groupBy(*KEYS, "cluster").agg(F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"))
    columns = [*KEYS, "kind", "comb", "cluster", "pc1", "pc2"]
    return (
        members.withColumn("kind", F.lit("point"))
        .select(*columns)
        .unionByName(centres.withColumns({"kind": F.lit("centre"), "comb": F.lit(None).cast("bigint")}).select(*columns))
    )


def _components(profile: DataFrame) -> DataFrame:
    """(segment, comb, pc1, pc2) of all segments at once, by subspace iteration over the cells.

    Directions are rows (segment, bin) and scores rows (segment, comb), with ``DIRECTIONS`` numbers each;
    histograms are centred by centring the scores, so nothing is ever as wide as the bins. Per segment
    only products of directions, a small matrix, come together.
    """
    axes = range(DIRECTIONS)
    cells = settle(profile.where(F.col("bin").isNotNull()).select(*KEYS, "comb", "bin", F.col("n").cast("double").alias("n")))
    combos_ = settle(profile.select(*KEYS, "comb").distinct())
    # repeatable starting numbers, spread over (-1, 1)
    start = [(F.xxhash64("bin", F.lit(j)) / F.lit(float(1 << 63))).alias(f"v{j}") for j in axes]
    directions = cells.select(*KEYS, "bin").distinct().select(*KEYS, "bin", *start)
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"g{i}_{j}") for i in axes for j in axes if i <= j]

    def scores(directions: DataFrame) -> DataFrame:
        raw = cells.join(directions, [*KEYS, "bin"]).groupBy(*KEYS, "comb").agg(*[F.sum(F.col("n") * F.col(f"v{j}")).alias(f"v{j}") for j in axes])
        raw = combos_.join(raw, [*KEYS, "comb"], "left").select(*KEYS, "comb", *[F.coalesce(f"v{j}", F.lit(0.0)).alias(f"v{j}") for j in axes])
        raw = settle(raw)
        means = raw.groupBy(*KEYS).agg(*[F.avg(f"v{j}").alias(f"m{j}") for j in axes])
        return raw.join(means, KEYS).select(*KEYS, "comb", *[(F.col(f"v{j}") - F.col(f"m{j}")).alias(f"v{j}") for j in axes])

    def turned(rows: DataFrame, name: str, basis: DataFrame) -> DataFrame:
        turn = [sum((F.col(f"v{i}") * F.col("t")[i * DIRECTIONS + j] for i in axes), F.lit(0.0)).alias(f"v{j}") for j in axes]
        return rows.join(basis, KEYS).select(*KEYS, name, *turn)

    for _ in range(PASSES):
        image = cells.join(scores(directions), [*KEYS, "comb"]).groupBy(*KEYS, "bin").agg(*[F.sum(F.col("n") * F.col(f"v{j}")).alias(f"v{j}") for j in axes])
        image = settle(image)
        # scaled by the largest number first, so that products stay in range
        top = F.greatest(*[F.max(F.abs(f"v{j}")) for j in axes])
        scale = image.groupBy(*KEYS).agg(top.alias("top"))
        image = image.join(scale, KEYS).select(*KEYS, "bin", *[F.when(F.col("top") > 0, F.col(f"v{j}") / F.col("top")).otherwise(0.0).alias(f"v{j}") for j in axes])
        basis = image.groupBy(*KEYS).agg(*products).groupBy(*KEYS).applyInPandas(_orthonormal, BASIS_SCHEMA)
        directions = settle(turned(image, "bin", basis))
    found = scores(directions)
    rotation = settle(found.groupBy(*KEYS).agg(*products).groupBy(*KEYS).applyInPandas(_rotation, BASIS_SCHEMA))
    loading = turned(directions, "bin", rotation)
    largest = [F.max_by(f"v{j}", F.struct(F.abs(f"v{j}"), -F.col("bin"))) for j in (0, 1)]
    signs = loading.groupBy(*KEYS).agg(*[F.when(x < 0, -1.0).otherwise(1.0).alias(f"s{j}") for j, x in enumerate(largest)])
    placed = turned(found, "comb", rotation).join(signs, KEYS)
    return placed.select(*KEYS, "comb", (F.col("v0") * F.col("s0")).alias("pc1"), (F.col("v1") * F.col("s1")).alias("pc2"))


BASIS_SCHEMA = "segment_group string, feature string, t array<double>"


def _products(pdf: pd.DataFrame) -> np.ndarray:
    """The small symmetric matrix of one segment."""
    out = np.zeros((DIRECTIONS, DIRECTIONS))
    for i in range(DIRECTIONS):
        for j in range(i, DIRECTIONS):
            out[i, j] = out[j, i] = pdf[f"g{i}_{j}"].iloc[0]
    return out


def _basis(key: tuple, matrix: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"segment_group": [key[0]], "feature": [key[1]], "t": [matrix.ravel().tolist()]})


def _orthonormal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The turn that makes a segment's directions orthonormal; directions without length become 0."""
    values, vectors = np.linalg.eigh(_products(pdf))
    kept = values > max(values.max(), 0.0) * 1e-13
    scaled = np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)
    return _basis(key, (vectors * scaled)[:, ::-1])


def _rotation(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The turn to principal components, largest variance first; those without variance become 0."""
    values, vectors = np.linalg.eigh(_products(pdf))
    kept = values > max(values.max(), 0.0) * 1e-12
    return _basis(key, (vectors * kept)[:, ::-1])

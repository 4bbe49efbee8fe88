"""Bin-to-cluster probability model, its in-sample quality, and batch scoring.

The only input of the classifier is the bin, so the table P(cluster | bin) is
its unregularised optimum. It is counted from (segment, bin, cluster) cells, and
so are all the metrics: no training row is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.columns import bin_third, published_edge
from massif.operators.binning import placed_bin
from massif.operators.bounded import join_null_safe, settle
from massif.operators.segments import KEYS

CELL = [*KEYS, "bin"]


def training_cells(profile: DataFrame, comb_cluster: DataFrame) -> DataFrame:
    """Training rows counted per (segment, bin, cluster); the null bin is a bin too."""
    return (
        profile.join(comb_cluster, [*KEYS, "comb"])
        .groupBy(*CELL, "cluster")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def count_bin_model(cells: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """Probability of each cluster for each bin with training rows, and once per segment for all other bins.

    ``label`` is the 0-based rank of the cluster. The rows with ``is_default`` hold the segment's cluster
    shares; they stand for every bin without training rows, the null bin included, so the model
    is as long as the counted cells and not as the axis. Segments with fewer than two
    clusters get no model.
    """
    cells = settle(cells)
    per_segment = Window.partitionBy(*KEYS)
    classes = cells.groupBy(*KEYS, "cluster").agg(F.sum("n").cast("bigint").alias("class_n"))
    classes = (
        classes.withColumn("label", (F.row_number().over(per_segment.orderBy("cluster")) - 1).cast("int"))
        .withColumn("classes", F.count("*").over(per_segment))
        .withColumn("prior", F.col("class_n") / F.sum("class_n").over(per_segment))
        .where("classes > 1")
    )
    trained = cells.groupBy(*CELL).agg(F.sum("n").alias("bin_n"))
    spine = classes.join(trained, KEYS)
    counted = join_null_safe(spine, cells, [*CELL, "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    columns = [*CELL, "cluster", "label", F.col("n").cast("bigint").alias("n"), F.col("bin_n").cast("bigint").alias("bin_n"), "p", "is_default"]
    share = (F.col("n") + smoothing) / (F.col("bin_n") + smoothing * F.col("classes"))
    none = F.lit(0).cast("bigint")
    # with smoothing, an empty bin has equal shares
    empty = F.lit(1.0) / F.col("classes") if smoothing > 0 else F.col("prior")
    others = classes.withColumns({"bin": F.lit(None).cast(cells.schema["bin"].dataType), "n": none, "bin_n": none, "p": empty, "is_default": F.lit(True)})
    return counted.withColumns({"p": share, "is_default": F.lit(False)}).select(*columns).unionByName(others.select(*columns))


def train_bin_model(cells: DataFrame, params: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """Probability of each cluster for each bin 1..n_bins and for the null bin; ``count_bin_model`` with all bins listed, a view of short axes."""
    held = settle(count_bin_model(cells, smoothing))
    others = held.where("is_default").drop("is_default", "bin")
    bins = F.concat(F.sequence(F.lit(1).cast("bigint"), F.col("n_bins").cast("bigint")), F.array(F.lit(None).cast("bigint")))
    spine = others.join(params.select(*KEYS, "n_bins"), KEYS).withColumn("bin", F.explode(bins)).drop("n_bins")
    known = held.where("not is_default").select(*CELL, "cluster", *(F.col(c).alias(f"own_{c}") for c in ("n", "bin_n", "p")))
    own = join_null_safe(spine, known, [*CELL, "cluster"], "left")
    return own.select(*CELL, "cluster", "label", *(F.coalesce(f"own_{c}", c).alias(c) for c in ("n", "bin_n", "p")))


def bin_predictions(model: DataFrame) -> DataFrame:
    """Per bin: classes, probabilities and the most probable cluster, first on ties.

    The rows of a model that stand for all other bins stay marked as such.
    """
    listed = F.array_sort(F.collect_list(F.struct("label", "cluster", "p")))
    keys = [*CELL, *(c for c in ("is_default",) if c in model.columns)]
    return (
        model.groupBy(*keys)
        .agg(listed.alias("m"))
        .select(
            *keys,
            F.col("m.cluster").alias("classes"),
            F.col("m.p").alias("probabilities"),
            F.element_at(
                "m.cluster", F.array_position("m.p", F.array_max("m.p")).cast("int")
            ).alias("predicted_cluster"),
        )
    )


# --- quality ----------------------------------------------------------------


def confusion(model: DataFrame) -> DataFrame:
    """Training rows per (segment, true cluster, predicted cluster)."""
    # bins without training rows, and the rows that stand for them, add nothing
    model = model.where("bin_n > 0")
    predicted = bin_predictions(model).select(*CELL, "predicted_cluster")
    return (
        join_null_safe(model, predicted, CELL)
        .groupBy(*KEYS, "cluster", "label", "predicted_cluster")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def accuracy(model: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("cluster") == F.col("predicted_cluster"), F.col("n")).otherwise(0))
    return confusion(model).groupBy(*KEYS).agg((hits / F.sum("n")).alias("accuracy"))


def classification_report(model: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    table = settle(confusion(model))
    hit = F.col("cluster") == F.col("predicted_cluster")
    truth = table.groupBy(*KEYS, "cluster", "label").agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits")
    )
    guessed = table.groupBy(*KEYS, F.col("predicted_cluster").alias("cluster")).agg(F.sum("n").alias("guessed"))
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    per_class = (
        truth.join(guessed, [*KEYS, "cluster"], "left")
        .withColumn("guessed", F.coalesce("guessed", F.lit(0)))
        .withColumn("precision", ratio(F.col("hits"), F.col("guessed")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )
    scores = ["precision", "recall", "f1"]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores]
    support = F.sum("support").alias("support")
    rows = per_class.select(*KEYS, F.col("label").cast("string").alias("class"), *scores, "support")
    macro = per_class.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in scores], support)
    mean = per_class.groupBy(*KEYS).agg(*weighted, support)
    return rows.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        mean.withColumn("class", F.lit("weighted avg"))
    )


def auroc(model: DataFrame) -> DataFrame:
    """One-vs-rest area under the ROC curve, weighted by class support."""
    scored = model.groupBy(*KEYS, "cluster", "p").agg(
        F.sum("n").alias("pos"), F.sum(F.col("bin_n") - F.col("n")).alias("neg")
    )
    rising = Window.partitionBy(*KEYS, "cluster").orderBy("p")
    below = F.coalesce(F.sum("neg").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_class = (
        scored.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
        .groupBy(*KEYS, "cluster")
        .agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("pos") > 0) & (F.col("neg") > 0))
        .withColumn("auc", F.col("wins") / (F.col("pos").cast("double") * F.col("neg")))
    )
    return per_class.groupBy(*KEYS).agg(
        (F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("auroc_weighted_ovr")
    )


def model_metadata(model: DataFrame, params: DataFrame) -> DataFrame:
    """One row per model: samples, features, classes, quality, label mapping."""
    entry = F.struct("label", "cluster")
    summary = (
        model.groupBy(*KEYS)
        .agg(
            F.sum("n").cast("bigint").alias("num_samples_trained"),
            F.array_sort(F.collect_set(entry)).alias("labels"),
        )
        .select(
            *KEYS,
            "num_samples_trained",
            F.size("labels").alias("num_classes"),
            F.map_from_entries("labels").alias("label_mapping"),
        )
    )
    return (
        summary.join(params.select(*KEYS, F.col("n_bins").alias("num_features")), KEYS)
        .join(accuracy(model), KEYS)
        .join(auroc(model), KEYS, "left")
    )


# --- scoring ----------------------------------------------------------------


def score_rows(long: DataFrame, params: DataFrame, predictions: DataFrame, edge_rule: str = "right") -> DataFrame:
    """Add bin, class probabilities, predicted cluster and context to long rows.

    Works on batch and streaming input. The context is the bounds of the bin,
    its third of the axis and a title. Rows without parameters or model keep
    null results and a ``reject_reason``. Predictions for all other bins of a segment, where there are
    such, hold for the bins that are not listed.
    """
    binned = long.join(params.select(*KEYS, "mn", "mx", "n_bins"), KEYS, "left").withColumn("bin", placed_bin(edge_rule))
    edge = lambda i: published_edge(i, F.col("mn"), F.col("mx"), F.col("n_bins"))
    title = F.format_string(
        "value %.2f: cluster %d", F.col("value"), F.col("predicted_cluster")
    )
    no_model = F.col("n_bins").isNull() | F.col("predicted_cluster").isNull()
    if "is_default" in predictions.columns:
        results = ["classes", "probabilities", "predicted_cluster"]
        others = predictions.where("is_default").select(*KEYS, *(F.col(c).alias(f"other_{c}") for c in results))
        found = join_null_safe(binned, predictions.where("not is_default").drop("is_default"), CELL, "left").join(others, KEYS, "left")
        found = found.withColumns({c: F.coalesce(c, f"other_{c}") for c in results}).drop(*(f"other_{c}" for c in results))
    else:
        found = join_null_safe(binned, predictions, CELL, "left")
    return (
        found.withColumn("bin_lower", edge(F.col("bin") - 1))
        .withColumn("bin_upper", edge(F.col("bin")))
        .withColumn("bin_third", bin_third(F.col("bin"), F.col("n_bins")))
        .withColumn("title", F.when(F.col("predicted_cluster").isNotNull(), title))
        .withColumn("reject_reason", F.when(no_model, "no model or parameters"))
        .drop("mn", "mx", "n_bins")
    )


def with_counts(scored: DataFrame, counts: DataFrame, whole: bool = False) -> DataFrame:
    """Add how many training rows the predicted cluster has in all and in the row's bin.

    ``counts`` has (segment, cluster, bin, ``n``, ``cluster_total``) for counted bins only; another bin
    of a known cluster has none. ``whole=True`` adds the list of (bin, n) of all counted bins. A row
    whose predicted cluster has no profile is rejected.
    """
    per_cluster = [*KEYS, "predicted_cluster"]
    named = counts.withColumnRenamed("cluster", "predicted_cluster")
    listed = [F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("cluster_counts")] if whole else []
    totals = named.groupBy(*per_cluster).agg(F.max("cluster_total").alias("cluster_total"), *listed)
    in_bin = named.select(*per_cluster, "bin", F.col("n").alias("cluster_in_bin"))
    none = F.when(F.col("cluster_total").isNotNull() & F.col("bin").isNotNull(), F.lit(0).cast("bigint"))
    return (
        scored.join(totals, per_cluster, "left")
        .join(in_bin, [*per_cluster, "bin"], "left")
        .withColumn("cluster_in_bin", F.coalesce("cluster_in_bin", none))
        .withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("cluster_total").isNull(), "no profile of the cluster")))
    )


def with_profile(scored: DataFrame, profiles: DataFrame, whole: bool = False) -> DataFrame:
    """Add how many training rows the predicted cluster has in all and in the row's bin.

    ``profiles`` has (segment, cluster, ``cluster_total``, ``cluster_counts``);
    ``whole=True`` keeps the counts of all bins on every row too. A row whose
    predicted cluster has no profile is rejected.
    """
    shown = profiles.select(
        *KEYS, F.col("cluster").alias("predicted_cluster"), "cluster_total", "cluster_counts"
    )
    out = (
        scored.join(shown, [*KEYS, "predicted_cluster"], "left")
        .withColumn("cluster_in_bin", F.element_at("cluster_counts", F.col("bin").cast("int")))
        .withColumn(
            "reject_reason",
            F.coalesce("reject_reason", F.when(F.col("cluster_total").isNull(), "no profile of the cluster")),
        )
    )
    return out if whole else out.drop("cluster_counts")

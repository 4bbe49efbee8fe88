"""The operators bound to the test tables, one named query each.

Main binding: ``events`` grouped by ``event_type``, combinations of weekday and
hour, measure ``value``, cut-off p15. Steps that follow clustering use a rule in
place of fitted clusters (hour div 8, or hour mod k), so that their results can
be checked by SQL; the fitted ones are separate queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from massif.functions import columns as C
from massif.operators import (
    binning,
    clustering,
    combos,
    composition,
    density,
    kselect,
    model,
    profiles,
    profiling,
    segments,
    silhouette,
)
from massif.operators.bounded import settle
from massif.operators.quantiles import exact_percentiles
from massif.operators.segments import KEYS
from massif.plans.batch import analyze
from massif.plans.spec import AnalysisSpec
from massif.session import scratch_path
from massif.sources import runs, tables
from massif.streaming import score as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CATS = ["weekday", "hour"]
LINE_CATS = ["l_linenumber", "o_orderpriority", "l_linestatus"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "ship_lag"]
HDR_EXCLUDED = 75.0
GROUP_NAMES = {"click": "Clicks", "view": "Page views", "NaN": "Unknown"}
FEATURE_NAMES = {"value": "Event value"}


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles}) if doubles else df


def events(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/events.parquet")
    return df.withColumns({"weekday": F.dayofweek("ts"), "hour": F.hour("ts")})


def events_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose errors have no type, midnight no hour, and every small value no measure."""
    return events(spark, folder).withColumns(
        {
            "event_type": F.when(F.col("event_type") != "error", F.col("event_type")),
            "hour": F.when(F.col("hour") != 0, F.col("hour")),
            "value": F.when(F.col("value") >= 1.0, F.col("value")),
        }
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).withColumn(
        "ship_lag", F.datediff("l_shipdate", "o_orderdate")
    )


@dataclass
class Parts:
    """The steps of the events analysis up to the combination profile."""

    kept: DataFrame
    rows: DataFrame
    long: DataFrame
    params: DataFrame

    @property
    def binned(self) -> DataFrame:
        return binning.quantize(self.long, self.params)

    @cached_property
    def profile(self) -> DataFrame:
        return settle(profiles.comb_profile(self.binned))

    @cached_property
    def ruled(self) -> DataFrame:
        """Cluster of each (segment, combination) by rule: hour div 8."""
        hours = self.kept.select("comb", F.floor(F.col("hour") / 8).cast("int").alias("cluster"))
        members = self.profile.select(*KEYS, "comb").distinct()
        return settle(members.join(hours, "comb").select(*KEYS, "comb", "cluster"))

    @cached_property
    def ruled_k(self) -> DataFrame:
        """Labels for k = 2..6 by rule: hour mod k."""
        ks = F.explode(F.sequence(F.lit(2), F.lit(6))).alias("k")
        hours = self.kept.select("comb", "hour", ks)
        members = self.profile.select(*KEYS, "comb").distinct()
        return settle(
            members.join(hours, "comb").select(
                *KEYS, "comb", "k", (F.col("hour") % F.col("k")).cast("int").alias("cluster")
            )
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return settle(profiles.cluster_profile(self.profile.join(self.ruled, [*KEYS, "comb"])))

    @cached_property
    def bin_model(self) -> DataFrame:
        return settle(model.count_bin_model(model.training_cells(self.profile, self.ruled)))


def prepared(spark: SparkSession, folder: str) -> Parts:
    df = events(spark, folder)
    cells = settle(binning.cell_stats(df, ["value"], "event_type", CATS))
    sizes = settle(cells.groupBy(*CATS).agg(F.sum("n").alias("n")))
    threshold = combos.cutoff(sizes, "p15")
    kept = settle(combos.number_combos(sizes.where(F.col("n") >= threshold), CATS))
    rows = combos.with_comb(df, kept, CATS)
    long = segments.to_long(rows, ["value"], "event_type", ["comb", "event_id"])
    stats = settle(binning.stats_from_cells(combos.with_comb(cells, kept, CATS), ["value"]))
    return Parts(kept, rows, long, binning.bin_params(long, stats=stats))


# --- scans ------------------------------------------------------------------


@query
def scan_parquet(spark, folder):
    return tables.load_table(spark, f"{folder}/customer.parquet")


@query
def scan_csv(spark, folder):
    path = scratch_path(spark, "customer") + ".csv"
    spark.read.parquet(f"{folder}/customer.parquet").write.option("header", "true").csv(path)
    df = tables.load_table(spark, path)
    return df.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query
def numeric_columns(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    found = tables.numeric_columns(df, ["l_orderkey", "no_such_column"])
    long = df.select(*[F.col(c).cast("double").alias(c) for c in found]).unpivot([], found, "column", "value")
    return long.groupBy("column").agg(
        F.count("value").alias("non_null"), F.min("value").alias("min"), F.max("value").alias("max")
    )


@query
def profile_table(spark, folder):
    return rounded(profiling.profile_table(spark.read.parquet(f"{folder}/part.parquet"), ["p_partkey"]), 4)


@query
def value_counts(spark, folder):
    return profiling.value_counts(spark.read.parquet(f"{folder}/part.parquet"), "p_brand")


@query
def top_values(spark, folder):
    return profiling.top_values(spark.read.parquet(f"{folder}/part.parquet"), "p_type")


@query
def n_unique(spark, folder):
    columns = ["event_type", "user_id", "weekday", "hour"]
    return profiling.n_unique(events_with_nulls(spark, folder), columns)


# --- combinations -----------------------------------------------------------


@query
def one_hot(spark, folder):
    return combos.one_hot(
        events_with_nulls(spark, folder), ["event_type", "weekday"], "user_id", ["value"], ["event_id"]
    )


@query
def comb_sizes(spark, folder):
    return combos.comb_sizes(events_with_nulls(spark, folder), ["event_type", *CATS])


@query
def comb_id(spark, folder):
    df = lines(spark, folder).withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    return combos.number_combos(settle(combos.comb_sizes(df, LINE_CATS)), LINE_CATS)


@query
def comb_id_partitioned(spark, folder):
    """Very many combinations, here users by event type."""
    cats = ["user_id", "event_type"]
    return combos.number_combos(combos.comb_sizes(events_with_nulls(spark, folder), cats), cats)


@query
def comb_size_stats(spark, folder):
    return rounded(combos.size_stats(combos.comb_sizes(events(spark, folder), CATS)))


@query
def comb_threshold_pct(spark, folder):
    sizes = settle(combos.comb_sizes(events(spark, folder), CATS))
    parts = [combos.percentile_cutoff(sizes, p).select(F.lit(p).alias("pct"), "threshold") for p in (0, 15, 50, 99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _size_sets(spark, folder):
    ev = events(spark, folder)
    part = spark.read.parquet(f"{folder}/part.parquet")
    return {
        "weekday_hour": combos.comb_sizes(ev, CATS),
        "user": combos.comb_sizes(ev, ["user_id"]),
        "part": combos.comb_sizes(part, ["p_type", "p_size"]),
        "event_type": combos.comb_sizes(ev, ["event_type"]),
        "line": combos.comb_sizes(lines(spark, folder), LINE_CATS),
    }


@query
def comb_threshold_knee(spark, folder):
    found = [
        combos.knee_cutoff(sizes).select(F.lit(name).alias("sizes"), "threshold")
        for name, sizes in _size_sets(spark, folder).items()
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query
def comb_min_size_filter(spark, folder):
    df = events_with_nulls(spark, folder)
    sizes = settle(combos.comb_sizes(df, CATS))
    kept = combos.keep_combos(df, sizes, CATS, combos.cutoff(sizes, "p50"))
    return kept.select("event_id", *CATS, "value")


@query
def retention(spark, folder):
    sizes = settle(combos.comb_sizes(events(spark, folder), CATS))
    return rounded(combos.retention(sizes, combos.cutoff(sizes, "p15")))


# --- segments and bins ------------------------------------------------------


@query
def segment_filter(spark, folder):
    chosen = segments.select_groups(events_with_nulls(spark, folder), "event_type", ["click", "view", "NaN"])
    return segments.to_long(chosen, ["value"], "event_type", ["event_id"])


@query
def segment_eligible(spark, folder):
    df = lines(spark, folder).withColumn("flat", F.lit(1.0))
    long = segments.to_long(df, [*LINE_MEASURES, "flat"], "l_returnflag")
    return binning.eligible(binning.segment_stats(long))


@query
def segment_name(spark, folder):
    long = segments.to_long(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_quantity", "l_tax"], "l_returnflag")
    named = long.groupBy(*KEYS).agg(F.count("*").alias("n"))
    named = named.withColumn("name", C.segment_name(F.col("segment_group"), F.col("feature")))
    parsed = C.parse_segment_name(F.col("name"), ["l_tax", "l_quantity"])
    return named.select(
        "name",
        "n",
        parsed["segment_group"].alias("parsed_group"),
        parsed["feature"].alias("parsed_feature"),
        C.safe_file_name(F.concat("name", F.lit(" a/b"))).alias("file_name"),
    )


@query
def display_names(spark, folder):
    df = events_with_nulls(spark, folder)
    long = segments.to_long(df, ["value"], "event_type", ["event_id"])
    return long.select(
        "event_id",
        C.display_name(F.col("segment_group"), GROUP_NAMES).alias("group_name"),
        C.display_name(F.col("feature"), FEATURE_NAMES).alias("feature_name"),
        C.unit_of(F.col("feature"), {"other": "hours"}).alias("unit"),
    )


@query
def percentiles_exact(spark, folder):
    """Percentiles by bracketing, the way taken for groups too large for one task."""
    long = segments.to_long(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_extendedprice"], "l_returnflag")
    found = exact_percentiles(long, KEYS, "value", [0.0, 0.25, 0.5, 0.9, 1.0], group_rows=1000, buckets=256)
    names = ["p0", "p25", "p50", "p90", "p100"]
    return rounded(found.select(*KEYS, *[F.col("pct")[i].alias(name) for i, name in enumerate(names)]), 4)


@query
def fd_bins(spark, folder):
    long = segments.to_long(lines(spark, folder), LINE_MEASURES, "l_returnflag")
    return rounded(binning.bin_params(long, units={"ship_lag": "days"}), 4)


@query
def document_bins(spark, folder):
    long = segments.to_long(spark.read.parquet(f"{folder}/documents.parquet"), ["n_chars"], "lang", ["doc_id"])
    return binning.quantize(long, binning.bin_params(long))


@query
def bin_edges(spark, folder):
    long = segments.to_long(lines(spark, folder), LINE_MEASURES, "l_returnflag")
    edges = binning.with_edges(binning.bin_params(long, 12))
    return rounded(edges.select(*KEYS, "n_bins", F.posexplode("bin_edges").alias("i", "edge")), 4)


@query
def quantize(spark, folder):
    long = segments.to_long(events_with_nulls(spark, folder), ["value"], "event_type", ["event_id"])
    return binning.quantize(long, binning.bin_params(long))


@query
def quantize_left(spark, folder):
    long = segments.to_long(
        spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_quantity"], None, ["l_orderkey", "l_linenumber"]
    )
    return binning.quantize(long, binning.bin_params(long, 49), edge_rule="left")


@query
def quantize_edges(spark, folder):
    """Whole quantities sit exactly on the edges of 49 right-closed bins."""
    long = segments.to_long(
        spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_quantity"], None, ["l_orderkey", "l_linenumber"]
    )
    return binning.quantize(long, binning.bin_params(long, 49))


@query
def bin_third(spark, folder):
    parts = prepared(spark, folder)
    placed = parts.binned.join(parts.params.select(*KEYS, "n_bins"), KEYS)
    third = C.bin_third(F.col("bin"), F.col("n_bins")).alias("third")
    return placed.groupBy(*KEYS, third).agg(F.count("*").alias("n"), F.min("bin").alias("low"), F.max("bin").alias("high"))


@query
def density_histogram(spark, folder):
    long = segments.to_long(events_with_nulls(spark, folder), ["value"], "event_type")
    stats = settle(binning.segment_stats(long))
    params = binning.bin_params(long, stats=stats)
    bars = density.density_histogram(long, stats, params, GROUP_NAMES, FEATURE_NAMES)
    return rounded(bars, 9).orderBy(F.when(F.col("segment_group") == C.NULL_GROUP, 1).otherwise(0), "segment_group", "bin")


@query
def box_stats(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    return rounded(density.box_stats(df, ["l_returnflag"], "l_extendedprice"), 4)


# --- profiles ---------------------------------------------------------------


@query
def comb_profile(spark, folder):
    return prepared(spark, folder).profile


@query
def line_profile(spark, folder):
    """Three measures of the line items at once; combinations keyed by their values."""
    long = segments.to_long(lines(spark, folder), LINE_MEASURES, "l_returnflag", LINE_CATS)
    return profiles.comb_profile(binning.quantize(long, binning.bin_params(long, 20)), LINE_CATS)


@query
def cluster_profile(spark, folder):
    return prepared(spark, folder).clusters


@query
def cluster_profile_pct(spark, folder):
    return rounded(profiles.profile_share(prepared(spark, folder).clusters))


@query
def profile_dense(spark, folder):
    parts = prepared(spark, folder)
    return profiles.dense_profile(parts.clusters, parts.params)


@query
def unpivot_profile(spark, folder):
    """Wide to the widest segment, long again, each segment to its own bins."""
    parts = prepared(spark, folder)
    widest = parts.params.agg(F.max("n_bins")).first()[0]
    wide = profiles.wide_profile(parts.clusters, widest)
    long = profiles.unpivot_profile(wide, [*KEYS, "cluster"], [f"c_{i}" for i in range(1, widest + 1)])
    own = parts.params.select(*KEYS, "n_bins")
    return long.join(own, KEYS).where(F.col("class_num") <= F.col("n_bins")).drop("n_bins")


@query
def hdr(spark, folder):
    parts = prepared(spark, folder)
    return rounded(density.high_density_region(parts.clusters, parts.params, HDR_EXCLUDED))


@query
def hdr_wide(spark, folder):
    parts = prepared(spark, folder)
    return rounded(density.high_density_region(parts.clusters, parts.params, 33.3))


@query
def profile_json(spark, folder):
    """The nested segment documents, written as JSON and read back."""
    parts = prepared(spark, folder)
    clustered = parts.clusters
    regions = density.high_density_region(clustered, parts.params, HDR_EXCLUDED)
    chosen = parts.params.select(*KEYS, F.lit(3).alias("k"))
    documents = profiles.profile_documents(
        profiles.run_profile(clustered, parts.params), parts.params, density.hdr_profile(regions), chosen
    )
    path = scratch_path(spark, "documents")
    tables.write_json(documents, path, "profiles", "r1")
    back = spark.read.schema(documents.schema).json(f"{path}/profiles/run_id=r1")
    each = back.withColumn("c", F.explode("clusters"))
    return rounded(
        each.select(
            "segment_name",
            "optimal_k_used",
            "quantization_bins",
            F.col("axis.edges").alias("edges"),
            F.col("c.cluster_id").alias("cluster_id"),
            F.col("c.total_items").alias("total_items"),
            F.col("c.hdr_profile.hdr_threshold_count").alias("hdr_threshold_count"),
            F.aggregate("c.bin_profiles", F.lit(0).cast("bigint"), lambda a, b: a + b["last_bin"] - b["first_bin"] + 1).cast("int").alias("bins_listed"),
            F.aggregate("c.bin_profiles", F.lit(0.0), lambda a, b: a + b["percentage_of_cluster"]).alias("percent"),
        )
    )


# --- clusters and composition -----------------------------------------------


@query
def label_rows(spark, folder):
    parts = prepared(spark, folder)
    labeled = composition.label_rows(parts.binned, parts.ruled)
    return labeled.select("event_id", *KEYS, "comb", "bin", "cluster")


@query
def cluster_composition(spark, folder):
    parts = prepared(spark, folder)
    return rounded(composition.cluster_composition(parts.kept, parts.ruled, CATS))


@query
def cluster_composition_segment(spark, folder):
    parts = prepared(spark, folder)
    counted = parts.long.groupBy(*KEYS, "comb").agg(F.count("*").alias("n"))
    cells = counted.join(parts.kept.drop("n"), "comb")
    return rounded(
        composition.cluster_composition(cells, parts.ruled, CATS, scope="segment")
    )


@query
def cluster_describe(spark, folder):
    parts = prepared(spark, folder)
    ruled = parts.ruled
    return rounded(composition.cluster_describe(parts.rows, ruled, ["value", "user_id"]), 5)


@query
def cluster_describe_segment(spark, folder):
    parts = prepared(spark, folder)
    ruled = parts.ruled
    rows = parts.rows.withColumn("segment_group", F.col("event_type"))
    return rounded(composition.cluster_describe(rows, ruled, ["value", "user_id"], scope="segment"), 5)


@query
def composition_union(spark, folder):
    parts = prepared(spark, folder)
    ruled = parts.ruled
    counted = composition.cluster_composition(parts.kept, ruled, CATS)
    described = composition.cluster_describe(parts.rows, ruled, ["value"])
    return rounded(composition.composition_union(counted, described), 5)


@query
def wcss(spark, folder):
    parts = prepared(spark, folder)
    return rounded(clustering.within_cluster_ss(parts.profile, parts.ruled_k), 5)


@query
def silhouette_query(spark, folder):
    parts = prepared(spark, folder)
    return rounded(silhouette.silhouette_scores(parts.profile, parts.ruled_k))


@query
def silhouette_squared(spark, folder):
    parts = prepared(spark, folder)
    return rounded(silhouette.silhouette_scores(parts.profile, parts.ruled_k, metric="squared_euclidean"))


@query
def silhouette_ordered(spark, folder):
    parts = prepared(spark, folder)
    # small blocks, so that combinations of one segment meet across many tiles
    samples = silhouette.silhouette_samples(parts.profile, parts.ruled_k, block=32)
    return rounded(silhouette.order_samples(settle(samples)))


def _ruled_scores(parts: Parts) -> DataFrame:
    return settle(clustering.k_scores(parts.profile, parts.ruled_k))


@query
def first_peak_k(spark, folder):
    return rounded(kselect.from_first_peak(_ruled_scores(prepared(spark, folder))).drop("wcss"))


@query
def optimal_k(spark, folder):
    return kselect.optimal_k(_ruled_scores(prepared(spark, folder)), 0.05)


@query
def elbow(spark, folder):
    scores = _ruled_scores(prepared(spark, folder))
    return rounded(kselect.elbow(scores, kselect.optimal_k(scores, 0.05)), 5)


# --- model ------------------------------------------------------------------


@query
def train_bin_model(spark, folder):
    """The counted model with every bin listed."""
    parts = prepared(spark, folder)
    return rounded(model.train_bin_model(model.training_cells(parts.profile, parts.ruled), parts.params))


@query
def clf_accuracy(spark, folder):
    return rounded(model.accuracy(prepared(spark, folder).bin_model))


@query
def clf_report(spark, folder):
    return rounded(model.classification_report(prepared(spark, folder).bin_model))


@query
def clf_auroc(spark, folder):
    return rounded(model.auroc(prepared(spark, folder).bin_model))


@query
def model_metadata(spark, folder):
    parts = prepared(spark, folder)
    record = model.model_metadata(parts.bin_model, parts.params)
    mapping = F.array_join(
        F.transform(F.map_entries("label_mapping"), lambda e: F.concat(e.key, F.lit(":"), e.value)), ","
    )
    return rounded(record.withColumn("label_mapping", mapping))


@query
def score_batch(spark, folder):
    parts = prepared(spark, folder)
    predictions = settle(model.bin_predictions(parts.bin_model))
    long = segments.to_long(events(spark, folder), ["value"], "event_type", ["event_id"])
    scored = model.score_rows(long, parts.params, predictions)
    return rounded(
        scored.select(
            "event_id",
            *KEYS,
            "bin",
            "predicted_cluster",
            F.array_max("probabilities").alias("probability"),
            F.size("classes").alias("n_classes"),
            "bin_lower",
            "bin_upper",
            "bin_third",
            "title",
        )
    )


def _scoring_tables(parts: Parts, groups: list[str] | None = None) -> streaming.ScoringTables:
    params = parts.params if groups is None else settle(parts.params.where(F.col("segment_group").isin(groups)))
    runs = profiles.run_profile(parts.clusters, params)
    return streaming.ScoringTables(
        AnalysisSpec(name="events", grouping="event_type", categorical=CATS, continuous=["value"]),
        "events",
        params,
        settle(model.bin_predictions(parts.bin_model)),
        settle(streaming.cluster_counts(runs)),
    )


def _run_stream(spark, folder, scoring, nulls=False):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = streaming.read_rows(spark, folder, schema, "parquet", pathGlobFilter="events.parquet")
    if nulls:
        rows = rows.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    out = scratch_path(spark, "scored")
    checkpoint = scratch_path(spark, "checkpoint")
    streaming.start_scoring(rows, scoring, out, checkpoint, available_now=True).awaitTermination()
    return out


@query
def stream_score(spark, folder):
    out = _run_stream(spark, folder, _scoring_tables(prepared(spark, folder)))
    scored = streaming.read_results(spark, out)
    return rounded(
        scored.select(
            F.col("instance.event_id").alias("event_id"),
            *KEYS,
            "bin",
            "predicted_cluster",
            F.array_max("probabilities").alias("probability"),
            "bin_third",
            "cluster_total",
            "cluster_in_bin",
        )
    )


@query
def stream_rejects(spark, folder):
    """Rows the stream refuses: errors come without a type, views have no model."""
    scoring = _scoring_tables(prepared(spark, folder), ["click", "purchase", "signup"])
    out = _run_stream(spark, folder, scoring, nulls=True)
    return streaming.read_results(spark, out, "rejected").select(
        F.col("instance.event_id").alias("event_id"), "segment_group", "reject_reason"
    )


@query
def stream_malformed(spark, folder):
    """Events as CSV text: errors have a word for the number, sign-ups a field too many, views no end of their quote."""
    number = F.when(F.col("event_type") == "error", "unreadable").otherwise(F.floor("value").cast("string"))
    more = F.when(F.col("event_type") == "signup", "1,more")
    quoted = F.when(F.col("event_type") == "view", F.lit('"view')).otherwise(F.col("event_type"))
    lines_ = events(spark, folder).select(F.concat_ws(",", "event_id", quoted, F.coalesce(more, number)))
    text = scratch_path(spark, "lines")
    lines_.write.text(text)
    rows = streaming.read_rows(spark, text, "event_id bigint, event_type string, value double", header="false")
    out = scratch_path(spark, "scored")
    scoring = _scoring_tables(prepared(spark, folder))
    streaming.start_scoring(rows, scoring, out, scratch_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return streaming.read_results(spark, out, "rejected").select(F.col("instance.event_id").alias("event_id"), F.col("instance.corrupt_record").alias("line"), "reject_reason")


# --- facts of fitted steps that SQL can state ---------------------------------


@query
def k_sweep_facts(spark, folder):
    """Per (segment, k): every combination labelled once, at most k clusters, no more spread than without clusters."""
    parts = prepared(spark, folder)
    labels = clustering.sweep_labels(parts.profile, parts.params, 1, 6)
    one = labels.select(*KEYS, "comb").distinct().select("*", F.lit(1).alias("k"), F.lit(0).alias("cluster"))
    scores = clustering.k_scores(parts.profile, labels)
    total = clustering.within_cluster_ss(parts.profile, one).select(*KEYS, F.col("wcss").alias("total_ss"))
    counted = labels.groupBy(*KEYS, "k").agg(
        F.count("*").alias("labelled"), F.countDistinct("comb").alias("combos"), (F.countDistinct("cluster") <= F.col("k")).alias("at_most_k")
    )
    facts = counted.join(scores, [*KEYS, "k"]).join(total, KEYS)
    return rounded(
        facts.select(
            *KEYS, "k", "labelled", "combos", "at_most_k", "total_ss",
            (F.col("wcss") <= F.col("total_ss") * 1.000001).alias("not_wider"),
            F.col("silhouette").between(-1.0, 1.0).alias("silhouette_in_range"),
        ),
        4,
    )


@query
def final_clusters_facts(spark, folder):
    """Per segment: combinations, clusters numbered from 0 without gaps, in the order of their mean bins."""
    parts = prepared(spark, folder)
    labels = clustering.sweep_labels(parts.profile, parts.params, 3, 3)
    chosen = parts.params.select(*KEYS, F.lit(3).alias("k"))
    final = settle(clustering.final_clusters(parts.profile, labels, chosen))
    mean = F.sum(F.col("bin") * F.col("n")) / F.sum("n")
    centres = parts.profile.where("bin IS NOT NULL").join(final, [*KEYS, "comb"]).groupBy(*KEYS, "cluster").agg(mean.alias("mean_bin"))
    step = F.col("mean_bin") - F.lag("mean_bin").over(Window.partitionBy(*KEYS).orderBy("cluster"))
    ordered = centres.withColumn("rises", F.coalesce(step >= 0, F.lit(True))).groupBy(*KEYS).agg(
        F.every("rises").alias("in_order"), (F.max("cluster") + 1 == F.count("*")).alias("without_gaps")
    )
    return final.groupBy(*KEYS).agg(F.count("*").alias("combos")).join(ordered, KEYS)


@query
def pca_facts(spark, folder):
    """Per segment: both components have mean 0, are orthogonal, fall in size and hold part of all variance."""
    parts = prepared(spark, folder)
    points = clustering.project_2d(parts.profile, parts.params, parts.ruled).where("kind = 'point'")
    one = parts.ruled.select(*KEYS, "comb", F.lit(1).alias("k"), F.lit(0).alias("cluster"))
    total = clustering.within_cluster_ss(parts.profile, one).select(*KEYS, F.col("wcss").alias("total_ss"))
    sums = points.groupBy(*KEYS).agg(
        F.count("*").alias("combos"),
        F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"),
        F.sum(F.col("pc1") * F.col("pc2")).alias("cross"),
        F.sum(F.col("pc1") ** 2).alias("first"), F.sum(F.col("pc2") ** 2).alias("second"),
    )
    size = F.sqrt(F.col("first"))
    return rounded(
        sums.join(total, KEYS).select(
            *KEYS, "combos", "total_ss",
            ((F.abs("m1") <= size * 1e-9) & (F.abs("m2") <= size * 1e-9)).alias("centred"),
            (F.abs("cross") <= F.col("first") * 1e-9).alias("orthogonal"),
            (F.col("first") >= F.col("second")).alias("falling"),
            (F.col("first") + F.col("second") <= F.col("total_ss") * 1.000001).alias("part_of_all"),
        ),
        4,
    )


@query
def outcome_facts(spark, folder):
    """Per segment of a whole analysis: rows of all cluster profiles, and dense regions within their clusters."""
    spec = AnalysisSpec(
        name="events", grouping="event_type", categorical=CATS, continuous=["value"], min_combination_size="p15", min_k=3, max_k=4, hdr_excluded_percent=HDR_EXCLUDED
    )
    result = analyze(events(spark, folder), spec)
    totals = result["filled_counts"].groupBy(*KEYS, "cluster").agg(F.sum("n").alias("cluster_rows"))
    within = result["hdr"].join(totals, [*KEYS, "cluster"]).groupBy(*KEYS).agg(F.every(F.coalesce(F.col("mass") <= F.col("cluster_rows"), F.lit(True))).alias("regions_within"))
    return totals.groupBy(*KEYS).agg(F.sum("cluster_rows").alias("profile_rows")).join(within, KEYS)


# --- runs -------------------------------------------------------------------


def _runs(spark, folder):
    """One run record per event: its time, its type, and purchases as finished runs."""
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return events(spark, folder).select(
        F.concat(F.when(F.col("hour") == 0, "x").otherwise(""), stamp, F.lit("_run_"), "event_type").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "done").otherwise("failed").alias("status"),
    )


@query
def latest_run(spark, folder):
    listed = _runs(spark, folder)
    finished = runs.latest_run(listed)
    unfinished = runs.latest_run(listed.withColumn("status", F.lit("failed")))
    return finished.withColumn("registry", F.lit("finished")).unionByName(
        unfinished.withColumn("registry", F.lit("unfinished"))
    )


@query
def run_time_text(spark, folder):
    return _runs(spark, folder).select("run_id", C.run_time_text(F.col("run_id")).alias("run_time")).distinct()


# --- fitted steps: no SQL equivalent ----------------------------------------


@query
def kmeans_fit(spark, folder):
    """Cluster sizes of distributed K-Means with three clusters, over all segments' combinations."""
    parts = prepared(spark, folder)
    labels = clustering.sweep_labels(parts.profile, parts.params, 3, 3)
    return labels.groupBy(*KEYS, "k", "cluster").agg(F.count("*").alias("combos"))


@query
def k_sweep(spark, folder):
    parts = prepared(spark, folder)
    return rounded(clustering.k_scores(parts.profile, clustering.sweep_labels(parts.profile, parts.params, 2, 6)))


@query
def final_clusters(spark, folder):
    parts = prepared(spark, folder)
    labels = clustering.sweep_labels(parts.profile, parts.params, 2, 6)
    scores = settle(clustering.k_scores(parts.profile, labels))
    best = kselect.optimal_k(kselect.from_first_peak(scores), 0.05)
    return clustering.final_clusters(parts.profile, labels, settle(best))


@query
def pca_projection(spark, folder):
    parts = prepared(spark, folder)
    return rounded(clustering.project_2d(parts.profile, parts.params, parts.ruled))


@query
def outcome_regions(spark, folder):
    """The whole analysis: per event type, the fitted clusters and their densest ranges."""
    spec = AnalysisSpec(
        name="events",
        grouping="event_type",
        categorical=CATS,
        continuous=["value"],
        min_combination_size="p15",
        min_k=3,
        max_k=8,
        hdr_excluded_percent=HDR_EXCLUDED,
    )
    result = analyze(events(spark, folder), spec)
    combos_in = result["comb_cluster"].groupBy(*KEYS, "cluster").agg(F.count("*").alias("combos"))
    return rounded(result["hdr"].join(combos_in, [*KEYS, "cluster"]))

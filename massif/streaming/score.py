"""Scoring new rows against a finished run with Structured Streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from massif.functions.columns import group_label, measure
from massif.operators import model
from massif.operators.bounded import settle
from massif.operators.segments import KEYS
from massif.plans.spec import AnalysisSpec
from massif.sources.runs import find_latest_run
from massif.sources.tables import read_table


#: Holds the text of a CSV or JSON row that does not fit the schema.
CORRUPT = "corrupt_record"
MALFORMED, NO_NUMBER = "malformed row", "measure is no number"


@dataclass(frozen=True)
class ScoringTables:
    """What scoring needs from a run: its parameters and three small tables."""

    spec: AnalysisSpec
    run_id: str
    params: DataFrame
    predictions: DataFrame
    profiles: DataFrame


def load_scoring_tables(spark: SparkSession, folder: str, run_id: str | None = None) -> ScoringTables:
    """Load the tables of one run, the latest by default."""
    run_id = run_id or find_latest_run(spark, folder)
    record = spark.read.parquet(f"{folder}/runs").where(F.col("run_id") == run_id).select("parameters").first()
    if record is None:
        raise FileNotFoundError(f"Run {run_id} not found below {folder}.")
    params = settle(read_table(spark, folder, "bin_params", run_id).drop("axis"))
    return ScoringTables(
        AnalysisSpec.from_json(record[0]),
        run_id,
        params,
        settle(model.bin_predictions(read_table(spark, folder, "bin_model", run_id))),
        settle(cluster_counts(read_table(spark, folder, "cluster_profile", run_id))),
    )


def cluster_counts(profile: DataFrame) -> DataFrame:
    """The counted bins of each cluster with its total, from its profile by bins or by runs (of which only counted bins have counts)."""
    named = profile.withColumnRenamed("first_bin", "bin") if "first_bin" in profile.columns else profile
    total = F.sum("n").over(Window.partitionBy(*KEYS, "cluster")).cast("bigint")
    return named.withColumn("cluster_total", total).where("n > 0").select(*KEYS, "cluster", F.col("bin").cast("bigint").alias("bin"), "n", "cluster_total")


def read_rows(
    spark: SparkSession, path: str, schema: StructType | str, source: str = "csv", files_per_batch: int | None = None, **options: str
) -> DataFrame:
    """Rows of a folder as they arrive; CSV, JSON and Parquet files, or any streaming source.

    A CSV or JSON row that does not fit the schema keeps its text in ``corrupt_record``; it is
    a reject and stops nothing.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    reader = spark.readStream.format(source)
    if source in ("csv", "json"):
        if CORRUPT not in schema.fieldNames():
            schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if source == "csv":
        reader = reader.option("header", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(schema).options(**options).load(path)


def score(
    rows: DataFrame,
    tables: ScoringTables,
    source: str = "stream",
    edge_rule: str = "right",
    whole_profile: bool = False,
) -> DataFrame:
    """One scored record per row and measure, with its context or the reason it failed.

    Stateless: every row is joined to the run's tables and nothing else. A malformed row and a
    measure given as text that is no number are rejects without results.
    """
    spec = tables.spec
    payload = F.struct(*[F.col(c) for c in rows.columns])
    grouped = spec.grouping is not None
    has_group = not grouped or spec.grouping in rows.columns
    group = group_label(spec.grouping) if has_group else F.lit(None).cast("string")
    missing_group = F.lit("no grouping column") if not has_group else F.lit(None).cast("string")
    if grouped and has_group:
        missing_group = F.when(F.col(spec.grouping).isNull(), "grouping value absent")
    empty = F.lit(True)
    for c in rows.columns:
        empty = empty & F.col(c).isNull()
    malformed = F.when(F.col(CORRUPT).isNotNull(), MALFORMED) if CORRUPT in rows.columns else F.lit(None).cast("string")
    # a measure of the run that the rows lack gives a record too, with its reason
    none = F.lit(None).cast("double")
    pairs = []
    for m in spec.continuous:
        value, reason = none, F.lit("measure absent")
        if m in rows.columns:
            value, reason = measure(m), F.lit(None).cast("string")
            if isinstance(rows.schema[m].dataType, StringType):
                number = F.col(m).try_cast("double")
                value, reason = F.when(~F.isnan(number), number), F.when(F.col(m).isNotNull() & number.isNull(), NO_NUMBER)
        pairs.append(F.struct(F.lit(m).alias("feature"), value.alias("value"), reason.alias("reason")))
    pairs = pairs or [F.struct(F.lit(None).cast("string").alias("feature"), none.alias("value"), F.lit("measure absent").alias("reason"))]
    long = rows.select(
        payload.alias("instance"),
        group.alias("segment_group"),
        F.coalesce(malformed, F.when(empty, "no payload"), missing_group).alias("row_reason"),
        F.explode(F.array(*pairs)).alias("m"),
    ).select(
        "instance",
        "segment_group",
        F.coalesce(F.when(F.col("row_reason").isin(MALFORMED, "no payload"), F.col("row_reason")), "m.reason", "row_reason").alias("row_reason"),
        "m.feature",
        "m.value",
    )
    scored = model.score_rows(long, tables.params, tables.predictions, edge_rule)
    scored = model.with_counts(scored, tables.profiles, whole_profile)
    unread = F.coalesce(F.col("row_reason").isin(MALFORMED, NO_NUMBER), F.lit(False))
    results = [c for c in scored.columns if c not in long.columns and c != "reject_reason"]
    scored = scored.withColumns({c: F.when(~unread, F.col(c)) for c in results})
    # a null group is a segment of its own when the run has one
    row_reason = F.when(
        (F.col("row_reason") != "grouping value absent") | F.col("predicted_cluster").isNull(), F.col("row_reason")
    )
    return scored.select(
        F.lit(tables.run_id).alias("run_id"),
        F.lit(source).alias("source"),
        *[c for c in scored.columns if c not in ("row_reason", "reject_reason")],
        F.coalesce(row_reason, F.col("reject_reason")).alias("reject_reason"),
    )


def start_scoring(
    rows: DataFrame,
    tables: ScoringTables,
    folder: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "10 seconds",
    source: str = "stream",
) -> StreamingQuery:
    """Write scored rows and rejects to Parquet, apart by ``status``.

    Each micro-batch writes one folder named by its number, so a batch that is
    run again after a failure replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        status = F.when(F.col("reject_reason").isNull(), "scored").otherwise("rejected")
        stamped = batch.withColumns({"processed_at": F.current_timestamp(), "status": status})
        stamped.write.mode("overwrite").partitionBy("status").parquet(f"{folder}/batch_id={number}")

    writer = score(rows, tables, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_results(spark: SparkSession, folder: str, status: str = "scored") -> DataFrame:
    """The ``scored`` or ``rejected`` rows written so far; the other folders are not read."""
    if status not in ("scored", "rejected"):
        raise ValueError("status must be 'scored' or 'rejected'.")
    return spark.read.parquet(folder).where(F.col("status") == status).drop("status")

"""The registry of finished runs and the gathering of their artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.sources.tables import _file_status

# Fixed value: the form of a run name.
RUN_NAME = r"^\d{8}_\d{6}_run_.*"


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run: a finished one first, else the newest well-formed name.

    ``runs`` has ``run_id`` and ``status``. Names start with the time, so the
    greatest name is the newest.
    """
    finished = F.max(F.when(F.col("status") == "done", F.col("run_id")))
    named = F.max(F.when(F.col("run_id").rlike(RUN_NAME), F.col("run_id")))
    return runs.agg(F.coalesce(finished, named).alias("run_id"))


def find_latest_run(spark: SparkSession, folder: str) -> str:
    path = f"{folder}/runs"
    if not _file_status(spark, path):
        raise FileNotFoundError(f"No run found below {folder}.")
    found = latest_run(spark.read.parquet(path)).first()[0]
    if found is None:
        raise FileNotFoundError(f"No run found below {folder}.")
    return found


def gather_artifacts(spark: SparkSession, path: str, extension: str = "json") -> DataFrame:
    """(file_name, content) of the files with one extension, sorted by name."""
    return (
        spark.read.option("wholetext", "true")
        .option("pathGlobFilter", f"*.{extension}")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"),
            F.col("value").alias("content"),
        )
        .orderBy("file_name")
    )

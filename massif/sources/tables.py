"""Reading and writing tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, StructField, StructType

from massif.operators.segments import KEYS

READERS = {
    ".csv": ("csv", {"header": "true", "inferSchema": "true"}),
    ".parquet": ("parquet", {}),
}


#: Names the save that wrote a row of a table stored by segment.
SAVE = "_save"


def _file_status(spark: SparkSession, path: str):
    """Bytes below a path on any Hadoop file system, or None when it is missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(target):
        return None
    return system.getContentSummary(target).getLength()


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read a table by file extension, with NaN turned into NULL.

    A missing path raises FileNotFoundError, an empty one ValueError, and any
    other failure, an unknown extension included, RuntimeError. Passing a schema
    spares CSV the extra pass that infers one.
    """
    size = _file_status(spark, path)
    if size is None:
        raise FileNotFoundError(f"There is no table at {path}.")
    if size == 0:
        raise ValueError(f"The table at {path} has no bytes.")
    found = re.search(r"\.[^./]+$", path.rstrip("/"))
    extension = found.group(0).lower() if found else ""
    if extension not in READERS:
        raise RuntimeError(f"No reader for '{extension}' files; there are readers for {', '.join(READERS)}.")
    source, options = READERS[extension]
    reader = spark.read.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema).option("inferSchema", "false")
    try:
        return nan_to_null(reader.load(path))
    except (PySparkException, Py4JJavaError) as exc:
        raise RuntimeError(f"The table at {path} cannot be read.") from exc


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in schema order; unknown exclusions are ignored."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in set(exclude)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Names of the text columns in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def safe_name(name: str) -> str:
    return name.replace(" ", "_").replace("/", "-")


def write_table(df: DataFrame, folder: str, name: str, run_id: str, formats: Sequence[str] = ("parquet",)) -> bool:
    """Write one result table of a run; nothing is written for an empty table.

    The path is fixed by table and run, and a repeated write replaces it. A Parquet table with
    segments has a folder for each of them.
    """
    if df is None:
        return False
    for source in formats:
        if source == "parquet" and set(KEYS) <= set(df.columns):
            if not write_segments(df, folder, name, run_id):
                return False
            continue
        target = f"{folder}/{safe_name(name)}" + ("" if source == "parquet" else f"_{source}") + f"/run_id={run_id}"
        writer = df.write.mode("overwrite").format(source)
        if source == "csv":
            writer = writer.option("header", "true")
        writer.save(target)
        if _dropped_if_empty(df, target, source):
            return False
    return True


def write_segments(df: DataFrame, folder: str, name: str, run_id: str) -> bool:
    """Write a table of a run with a folder per segment, and the record that commits it.

    Only the folders of segments in ``df`` are replaced. The record is taken away first and
    written last, so a save that failed is not read; it names the save, and rows of segments
    that an earlier save of the run had and this one lacks are passed over. An empty table
    leaves no record.
    """
    if SAVE in df.columns:
        raise ValueError(f"A stored table cannot have a column '{SAVE}'.")
    spark, target, record = df.sparkSession, _run_path(folder, name, run_id), _run_path(f"{folder}/commits", name, run_id)
    _delete(spark, record)
    save = uuid.uuid4().hex
    spread = df.withColumn(SAVE, F.lit(save)).hint("rebalance", *[F.col(k) for k in KEYS])
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(target)
    if not _file_status(spark, target):
        return False
    written = _segmented(spark, target, target, df.schema).where(F.col(SAVE) == save)
    if written.isEmpty():
        return False
    # the columns as saved, so that a reader needs no file footers
    written.agg(F.lit(save).alias("save"), F.count("*").alias("rows"), F.lit(df.schema.json()).alias("columns")).write.mode("overwrite").parquet(record)
    return True


def _run_path(folder: str, name: str, run_id: str) -> str:
    return f"{folder}/{safe_name(name)}/run_id={run_id}"


def _delete(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _segmented(spark: SparkSession, base: str, path: str, columns: StructType) -> DataFrame:
    """Rows below ``path`` in the saved order of columns; segment names stay text, whatever they look like."""
    fields = [StructField(f.name, StringType() if f.name in KEYS else f.dataType) for f in columns]
    rows = spark.read.schema(StructType([*fields, StructField(SAVE, StringType())])).option("basePath", base).parquet(path)
    # a folder cannot be named by an empty text
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in KEYS else c for c in columns.fieldNames()], SAVE)


def _segment_folder(spark: SparkSession, segment: Sequence[str]) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(escape.getPartitionPathString(k, v) for k, v in zip(KEYS, segment, strict=True))


def _dropped_if_empty(df: DataFrame, target: str, source: str) -> bool:
    """Remove a folder just written when it holds no row: the table itself is computed only once."""
    spark = df.sparkSession
    reader = spark.read.schema(df.schema).format(source)
    if not reader.options(**({"header": "true"} if source == "csv" else {})).load(target).isEmpty():
        return False
    _delete(spark, target)
    return True


def read_table(spark: SparkSession, folder: str, name: str, run_id: str, segment: Sequence[str] | None = None) -> DataFrame:
    """Read one result table of one run, or one of its segments (group, feature); only that folder is listed."""
    path, record = _run_path(folder, name, run_id), _run_path(f"{folder}/commits", name, run_id)
    committed = _file_status(spark, record)
    if not committed and (segment is not None or not _file_status(spark, path) or _has_segments(spark, path)):
        raise FileNotFoundError(f"Run {run_id} has no finished table '{name}' below {folder}.")
    if not committed:
        return spark.read.parquet(path)
    saved = spark.read.parquet(record).first()
    target = path if segment is None else f"{path}/{_segment_folder(spark, segment)}"
    if not _file_status(spark, target):
        raise FileNotFoundError(f"Table '{name}' of run {run_id} has no segment {segment}.")
    columns = StructType.fromJson(json.loads(saved["columns"]))
    return _segmented(spark, path, target, columns).where(F.col(SAVE) == saved["save"]).drop(SAVE)


def _has_segments(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{KEYS[0]}=*")
    return len(target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(target) or []) > 0


def write_json(df: DataFrame, folder: str, name: str, run_id: str) -> bool:
    """Write nested rows as JSON lines."""
    if df is None:
        return False
    target = f"{folder}/{safe_name(name)}/run_id={run_id}"
    df.write.mode("overwrite").json(target)
    return not _dropped_if_empty(df, target, "json")

"""Small table helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.operators.bounded import stored
from massif.session import shared_folder

__all__ = ["read_table", "stored", "written", "discard", "fresh", "text_or_empty", "local_conf_int"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(label: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = f"__{label}"
    while name.lower() in taken:
        name = f"__{label}_{uuid.uuid4().hex[:6]}"
    return name


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def local_conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value else default


def ensure_shared(spark: SparkSession) -> None:
    shared_folder(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and let go of the shuffle files behind it."""
    out = stored(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` gave, when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

"""Settling intermediate tables: bounded ones become local, others a stored table.

Parameter, map and model tables are reused by many later steps and joined to
large row sets. ``settle`` computes such a table once. When it is proven to fit
the limits below it becomes a local relation, whose exact size lets Catalyst
broadcast it under ``spark.sql.autoBroadcastJoinThreshold``. A larger table is
written to the shared folder: its file size again tells Catalyst whether it may
be broadcast, and beyond the threshold it joins by shuffle, where adaptive
execution splits skewed keys.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.session import scratch_path

LOCAL_ROWS = 50_000
LOCAL_BYTES = 16 << 20


def settle(df: DataFrame, rows: int = LOCAL_ROWS, size: int = LOCAL_BYTES) -> DataFrame:
    """Compute ``df`` once and cut its lineage."""
    spark = df.sparkSession
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        head = held.limit(rows + 1).toArrow()
        if head.num_rows <= rows and head.nbytes <= size:
            return spark.createDataFrame(head, schema=df.schema)
        return stored(held, "settled")
    finally:
        held.unpersist()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null; the key columns of ``left`` are kept."""
    if not on:
        raise ValueError("join_null_safe needs at least one key column")
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"__{c}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__{c}" for c in on])

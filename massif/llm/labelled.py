"""Bounded samples of labelled documents, and scoring over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tables import fresh
from massif.llm.text import text_chunks

#: At most so many labelled documents of each label are learnt from.
SAMPLE_PER_LABEL = 800


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str, text_col: str, per_label: int = SAMPLE_PER_LABEL) -> tuple[pa.Array, np.ndarray, float]:
    """Texts and labels of up to ``per_label`` documents of each label for which ``learn`` holds, and the share of label 1 among all of them.

    The choice follows a hash of the id. A document labelled twice counts with the larger label.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0)) if counts else 0.5
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), id_col), id_col).limit(per_label)
        picked = part if picked is None else picked.union(part)
    key = fresh("label_id", docs)
    found = docs.select(F.col(id_col).alias(key), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col(key) == F.col(id_col))
    table = found.select(key, "y", "text").orderBy(key, "text").toArrow()  # at most 2 * per_label documents
    texts = table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    return texts, table.column("y").to_numpy().astype(np.int64), share


def score_documents(docs: DataFrame, score: Callable, fields: str, id_col: str, text_col: str, beside: str | None = None) -> DataFrame:
    """id and ``fields`` for every row; ``score(data, offsets)`` gives the columns of a chunk.

    With ``beside`` the whole rows are returned, with ``fields`` as a struct of that name behind their columns.
    """
    names = ["id", *T._parse_datatype_string(fields).fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *score(data, offsets)], names)

    def run_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                scored = pa.StructArray.from_arrays(score(data, offsets), names[1:])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, scored], [*batch.schema.names, beside])

    if beside:
        at = [c.lower() for c in docs.columns].index(text_col.lower())
        return docs.mapInArrow(run_beside, T.StructType([*docs.schema.fields, T.StructField(beside, T._parse_datatype_string(fields))]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(fields).fields])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)

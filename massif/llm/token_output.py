"""Token ids as Simple-8b words, written in id order and read back.

A shard is a range of document ids. It is a sequence of blocks; a block holds the ids of
whole documents as 64-bit words: four bits select how many values of how many bits a word
packs. Values too large for a word are marked by an all-ones word and kept in an escape
list. Every block states where its words and its ids begin in the shard, so blocks are
decoded independently, all words of a selector at once. Shards are stored as rows of a
Parquet table, one per block, which Spark commits as a whole.

Defined cases: a null or empty text is the end id alone; a null document id comes first;
rows that repeat an id follow each other, ordered by text; an empty table gives an empty
table. Other columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tables import stored
from massif.llm.tokenization import encode_column

END_ID = 1
BLOCK_IDS = 1 << 16
#: Values per word and bits per value, by selector.
PER_WORD = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = (1 << 60) - 1
U = np.uint64


#: The narrowest width for a value, by the exponent of the nearest double (those that round up to 2**60 need 60).
WIDTHS = np.array([min(b for b in BITS if b >= min(e, 60)) for e in range(62)], np.uint8)


def _widest(need: np.ndarray) -> dict[int, np.ndarray]:
    """For each number of values per word, the widest of so many from each place on; there are none past the end."""
    n, most = len(need), max(PER_WORD)
    spans, out = [np.concatenate([need, np.zeros(most, np.uint8)])], {}
    for k in range(most.bit_length() - 1):
        spans.append(np.maximum(spans[k][: -1 << k], spans[k][1 << k :]))
    for count in PER_WORD:
        k = count.bit_length() - 1
        out[count] = np.maximum(spans[k][:n], spans[k][count - (1 << k) :][:n])
    return out


def encode_simple8b(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of unsigned 64-bit values."""
    values = np.asarray(values, U)
    n = len(values)
    escaped = values >= U(ESCAPE)
    escapes = values[escaped]
    values = np.where(escaped, U(ESCAPE), values)
    widest = _widest(WIDTHS[np.frexp(values.astype(np.float64))[1]])
    choice = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):  # the most values that fit
        choice[widest[PER_WORD[s]] <= BITS[s]] = s
    step = np.array(PER_WORD)[choice].tolist()
    at, starts = 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    words = chosen.astype(U) << U(60)
    padded = np.concatenate([values, np.zeros(max(PER_WORD), U)])
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        for j in range(PER_WORD[s]) if len(rows) else ():
            words[rows] |= padded[starts[rows] + j] << U(j * BITS[s])
    return words, escapes


def decode_simple8b(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words."""
    words = np.asarray(words, U)
    chosen = (words >> U(60)).astype(np.int64)
    counts = np.array(PER_WORD)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), U)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            mask = U((1 << BITS[s]) - 1)
            for j in range(PER_WORD[s]):
                out[starts[rows] + j] = (words[rows] >> U(j * BITS[s])) & mask
    out = out[:n]
    if len(escapes):
        out[out == U(ESCAPE)] = escapes
    return out


BLOCK = "shard int, block int, word_start bigint, id_start bigint, n_ids bigint, words binary, escapes binary, n_tokens array<bigint>"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Encode, append the end id, and write the shards; returns the written block table.

    ``added`` matches the vocabulary's added tokens in the texts, as the library does by default.
    """
    id_type = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block = word_start = id_start = 0
        end = np.array([end_id], np.uint32)

        def close(doc_ids: list, parts: list, sizes: list) -> pa.RecordBatch:
            nonlocal block, word_start, id_start
            ids = np.concatenate(parts)
            words, escapes = encode_simple8b(ids)
            row = [pa.array([x], k) for x, k in ((shard, pa.int32()), (block, pa.int32()), (word_start, pa.int64()), (id_start, pa.int64()), (len(ids), pa.int64()), (words.astype("<u8").tobytes(), pa.binary()), (escapes.astype("<u8").tobytes(), pa.binary()), (sizes, pa.list_(pa.int64())))]
            block, word_start, id_start = block + 1, word_start + len(words), id_start + len(ids)
            named = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), pa.concat_arrays(doc_ids))
            return pa.RecordBatch.from_arrays([*row, named], [*(x.split()[0] for x in BLOCK.split(", ")), "doc_ids"])

        doc_ids, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for row, ids in enumerate(encode_column(tokenizer, batch.column(1), added)):
                doc_ids.append(batch.column(0).slice(row, 1))
                parts += [ids, end]
                sizes.append(len(ids) + 1)
                held += sizes[-1]
                if held >= block_ids:
                    yield close(doc_ids, parts, sizes)
                    doc_ids, parts, sizes, held = [], [], [], 0
        if parts:
            yield close(doc_ids, parts, sizes)

    schema = T.StructType([*T._parse_datatype_string(BLOCK).fields, T.StructField("doc_ids", T.ArrayType(id_type))])
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first())
    return stored(ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "text").mapInArrow(encode, schema), "simple8b")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """One row per document from the written blocks: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    id_type = blocks.schema["doc_ids"].dataType.elementType
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard
    base = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base_, id_start, n, words, escapes, sizes = (batch.column(k)[row].as_py() for k in range(6))
                ids = decode_simple8b(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"), n).astype("<u4")
                sizes = np.array(sizes, np.int64)
                ends = np.cumsum(sizes)
                named = batch.column(6)[row].values
                raw = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(base_ + id_start + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("start bigint, n_tokens bigint, ids_crc32 bigint, ids binary").fields])
    rows = blocks.join(base, "shard").select("base", "id_start", "n_ids", "words", "escapes", "n_tokens", "doc_ids")
    return rows.mapInArrow(decode, schema)

"""Packing documents into training sequences by exact complements, then best fit.

Lengths, not documents, are planned: a sequence capacity bounds the number of distinct
lengths, so the histogram and the plan made from it stay small however many documents
there are. The plan fills gaps exactly with one, two or three lengths whose sum is the
gap (looked up by sum among the lengths still available), as often as the counts allow,
and places what is left by best fit, largest first. Pieces are then dealt to the plan by
their rank within their length; ranks come from counts per (task, length), so a length
that a third of all pieces share needs no big group.

Defined cases: a null or empty text is the end id alone; a null id is passed through; rows
that repeat are packed as often as they come; an empty table gives no rows. Other columns
are passed over.
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

CAPACITY = 2048
END_ID = 0

#: A run of equal sequences: how many, and the lengths in each.
Run = tuple[int, tuple[int, ...]]


def _combination(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the largest first; counts are respected."""
    if gap < len(have) and have[gap] > 0:
        return (gap,)
    free = have[: gap + 1] > 0
    firsts = np.flatnonzero(free)[::-1]
    for a in firsts[gap - firsts <= firsts]:  # pairs a >= b
        b = gap - a
        if 0 < b and free[b] and (a != b or have[a] > 1):
            return int(a), int(b)
    pair = np.zeros(gap + 1, bool)
    for a in firsts:  # triples a >= b >= c
        rest = gap - a
        if rest > 2 * a or rest < 2:
            continue
        pair = free[1:rest] & free[1:rest][::-1]
        for b in (np.flatnonzero(pair) + 1)[::-1]:
            c = rest - b
            if c <= b <= a and (have[a] >= 1 + (a == b) + (a == c)) and (have[b] >= 1 + (b == a) + (b == c)):
                return int(a), int(b), int(c)
    return None


def plan_sequences(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of sequences that take every length as often as it is there."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        have[length] += n
    runs: list[Run] = []
    if have[capacity]:
        runs.append((int(have[capacity]), (capacity,)))
        have[capacity] = 0
    left: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            found = _combination(capacity - length, have)
            have[length] += 1
            if found is None:
                left.append((length, int(have[length])))
                have[length] = 0
                break
            whole = (length, *found)
            times = min(int(have[x]) // whole.count(x) for x in set(whole))
            for x in whole:
                have[x] -= times
            runs.append((times, whole))
    # best fit of the rest, in runs: open sequences by free space
    open_: dict[int, list[Run]] = {}
    for length, n in left:
        while n:
            space = min((s for s in open_ if s >= length), default=None)
            if space is None:
                each = capacity // length
                for times, members in ((n // each, each), (1, n % each)):
                    if times and members:
                        open_.setdefault(capacity - members * length, []).append((times, (length,) * members))
                break
            times, held = open_[space].pop()
            if not open_[space]:
                del open_[space]
            used = min(times, n)
            if times > used:
                open_.setdefault(space, []).append((times - used, held))
            open_.setdefault(space - length, []).append((used, (*held, length)))
            n -= used
    for space in sorted(open_):
        runs.extend(open_[space])
    return runs


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each slot run, its first sequence, its offset in the sequence."""
    taken: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for times, members in runs:
        offset = 0
        for length in members:
            rank = taken.get(length, 0)
            found.setdefault(length, []).append((rank, first, offset))
            taken[length] = rank + times
            offset += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


PIECES = "piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, part bigint, local_rank bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """The pieces of every document with their ids (little-endian unsigned 32-bit), stored.

    Added tokens of the vocabulary are matched in the texts, unless ``added`` is false.

    Only a longer document is cut; its first piece is the shorter one. ``part`` and
    ``local_rank`` number the pieces of each length within the writing task.
    """
    id_type = docs.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of = encode_column(tokenizer, batch.column(1), added)
            rows, out, held = [], {k: [] for k in ("piece", "start", "length", "ids", "ids_crc32", "local_rank")}, 0
            for row, ids in enumerate(ids_of):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                size = len(ids)
                cuts = [0, *range(size % capacity or capacity, size + 1, capacity)] if size > capacity else [0, size]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    rows.append(row)
                    for key, value in zip(out, (k, a, b - a, raw, zlib.crc32(raw), ranks[b - a]), strict=True):
                        out[key].append(value)
                    ranks[b - a] += 1
                    held += len(raw)
                if held > 1 << 22:
                    yield emit(batch, rows, out, part)
                    rows, out, held = [], {k: [] for k in out}, 0
            if rows:
                yield emit(batch, rows, out, part)

    def emit(batch: pa.RecordBatch, rows: list, out: dict, part: int) -> pa.RecordBatch:
        kinds = {"piece": pa.int32(), "ids": pa.binary()}
        columns = {"id": batch.column(0).take(pa.array(rows, pa.int64()))} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}
        columns["part"] = pa.array(np.full(len(rows), part, np.int64))
        names = ["id", *(x.split()[0] for x in PIECES.split(", "))]
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    schema = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string(PIECES).fields])
    cut_rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)
    return stored(cut_rows, "pieces").withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; the sequences are gapless and hold each piece once."""
    per_task = pieces.groupBy("part", "length").count()
    per_task = stored(per_task, "lengths")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = places(plan_sequences(histogram, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("base", "part", "local_rank")
    kept = ranked.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(kept.index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = lengths == length
                first, seq, at = runs[int(length)]
                slot = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = seq[slot] + ranks[rows] - first[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields, *T._parse_datatype_string("sequence_id bigint, offset bigint").fields])
    return ranked.mapInArrow(deal, schema).drop("rank")

"""Which windows of consecutive units occur more than once in a corpus.

Shared by the word and the byte form. Every window chooses one of its grams by winnowing
(an anchor); equal windows choose equal anchors, so a window that occurs twice has an
anchor that occurs twice. The steps, each a Spark job over the whole input:

1. ``scan``: anchors of all documents, and the digest of every document as it is.
2. ``repeated_cells``: each task counts its anchors in a sketch of hashed cells; the sketches
   are summed. Cells overestimate: no repeated anchor is lost.
3. ``suspects``: documents with anchors in repeated cells, with their texts.
4. ``contexts``: per suspected anchor occurrence, the hash of all its windows' units. Equal
   contexts are counted with map-side combining; those that occur twice are repeated whole.
5. What is left (anchors with several contexts) is decided window by window by the caller.
6. ``finish``: covered units are removed.

Hot anchors cost one row per task in the counts; joins on them are exchanged on both sides
so that adaptive execution can split them. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tables import written
from massif.llm.text import _BYTES, Rolling, U, Words, anchors, mix, text_chunks

#: Cells of the sketch: the leading bits of an anchor's hash.
CELL_BITS = 40
SKETCH_FLUSH = 1 << 22


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``words`` or bytes; gram and window size in units."""

    words: bool
    gram: int
    window: int


class Scanned:
    """A chunk's units: rolling hashes, document bounds in units, anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: Unit):
        if unit.words:
            found = Words(data, offsets)
            values, self.bounds = found.hashes(), found.bounds
        else:
            values, self.bounds = _BYTES[1][data], offsets
        self.rolling = Rolling(values, 2)
        grams = self.rolling.windows(unit.gram)
        self.place, self.first, self.count = anchors(grams, unit.gram, unit.window, self.bounds)
        self.anchor = grams[self.place] if len(self.place) else np.zeros(0, U)
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        self.unit = unit

    def context(self, rows: np.ndarray) -> np.ndarray:
        """Hash of the units of all windows of the given anchors."""
        first, count = self.first[rows], self.count[rows]
        raw = self.rolling.slices(first, first + count + self.unit.window - 1)
        return mix(raw ^ mix((count * 65536 + self.place[rows] - first).astype(U)))

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into rows, start, hash) of every window of the given anchors."""
        count = self.count[rows]
        of = np.repeat(np.arange(len(rows)), count)
        start = np.repeat(self.first[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return of, start, mix(self.rolling.slices(start, start + self.unit.window))


def _kept(text: bytes, unit: Unit, covered: np.ndarray | None) -> bytes:
    if unit.words:
        words = text.split()
        return b" ".join(words if covered is None else [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone])
    return text if covered is None else np.frombuffer(text, np.uint8)[~covered].tobytes()


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null: empty) and the text's hash: rows with the same key are the same document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tkey"))


def scan(docs: DataFrame, unit: Unit) -> DataFrame:
    """Stored: uid, id, tkey, n_units, digest, and the anchors as cells and places (in units from the document's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                got = Scanned(data, offsets, unit)
                raw = data.tobytes()
                digests = [hashlib.sha256(_kept(raw[a:b], unit, None)).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
                sizes = np.bincount(got.doc, minlength=hi - lo) if len(got.doc) else np.zeros(hi - lo, np.int64)
                cells = (got.anchor >> U(64 - CELL_BITS)).astype(np.int64)
                places = (got.place - got.bounds[got.doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(np.diff(got.bounds).astype(np.int64)),
                        pa.array(digests),
                        _lists(cells, sizes, pa.int64()),
                        _lists(places, sizes, pa.int32()),
                    ],
                    ["id", "tkey", "n_units", "digest", "cells", "places"],
                )

    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("tkey bigint, n_units bigint, digest string, cells array<bigint>, places array<int>").fields])
    rows = docs.select("id", "text", "tkey").mapInArrow(run, schema)
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), "anchors")


def repeated_cells(scanned: DataFrame) -> DataFrame:
    """Cells counted at least twice in the sum of all tasks' sketches."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["cell", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size > SKETCH_FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    sketches = scanned.select("cells").mapInArrow(sketch, "cell bigint, n bigint")
    return sketches.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell")


def suspects(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored: uid, text, and the places of anchors whose cell is repeated."""
    marks = scanned.select("uid", F.explode(F.arrays_zip("cells", "places")).alias("a")).select("uid", F.col("a.cells").alias("cell"), F.col("a.places").alias("place"))
    # stored, so that the join exchanges both sides and a hot cell can be split
    cells = written(repeated_cells(scanned), "cells")
    marked = written(marks.join(cells, "cell", "left_semi").groupBy("uid").agg(F.collect_list("place").alias("places")), "marked")
    names = scanned.select("uid", F.col("id").alias("own"), F.col("tkey").alias("own_key"))
    named = names.join(marked, "uid")
    texts = docs.join(named, (docs["tkey"] == F.col("own_key")) & docs["id"].eqNullSafe(F.col("own"))).select("uid", "text", "places")
    if not names.groupBy("own", "own_key").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["uid"])  # rows that repeat id and text meet each other's names
    return written(texts, "suspects")


def per_suspect(rows: DataFrame, extra: str, unit: Unit, fields: str, make: Callable) -> DataFrame:
    """Scan suspects again; ``make(scanned, batch, lo, hi, data, offsets)`` gives the columns of ``fields``."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                got = Scanned(data, offsets, unit)
                yield pa.RecordBatch.from_arrays(make(got, batch, lo, hi, data, offsets), names)

    return rows.select("uid", "text", extra).mapInArrow(run, fields)


def listed(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[pa.Array, np.ndarray]:
    """The flat values of the third column's lists in the rows, and each value's row."""
    part = batch.column(2).slice(lo, hi - lo)
    sizes = np.diff(part.offsets.to_numpy())
    return part.flatten(), np.repeat(np.arange(hi - lo), sizes)


def pick(got: Scanned, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Index of the anchors at the given places of the given documents."""
    return np.searchsorted(got.place, np.sort(place + got.bounds[doc]))


def occurrences(texts: DataFrame, unit: Unit) -> DataFrame:
    """Stored: anchor, ctx, uid, place, first, count of every suspected anchor occurrence."""

    def make(got, batch, lo, hi, data, offsets):
        place, doc = listed(batch, lo, hi)
        rows = pick(got, doc, place.to_numpy(zero_copy_only=False))
        owner = got.doc[rows]
        base = got.bounds[owner]
        uid = batch.column(0).slice(lo, hi - lo).to_numpy()[owner]
        return [
            pa.array(got.anchor[rows].view(np.int64)), pa.array(got.context(rows).view(np.int64)), pa.array(uid),
            pa.array((got.place[rows] - base).astype(np.int32)), pa.array((got.first[rows] - base).astype(np.int32)), pa.array(got.count[rows].astype(np.int32)),
        ]

    return written(per_suspect(texts, "places", unit, "anchor bigint, ctx bigint, uid bigint, place int, first int, count int", make), "occurrences")


def contexts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of windows proven repeated: uid, first, count; contexts still open: anchor, n, contexts, uid, place).

    A context that occurs twice is repeated. An open row is one occurrence of each context
    of an anchor that has several, with the number of its occurrences.
    """
    counted = written(found.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place")).alias("one")), "contexts")
    whole = counted.filter("n > 1").select("anchor", "ctx")  # of a stored table: both sides are exchanged
    sure = found.join(whole, ["anchor", "ctx"], "left_semi").select("uid", "first", "count")
    several = counted.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    open_ = counted.join(several, "anchor").select("anchor", "n", "contexts", F.col("one.uid").alias("uid"), F.col("one.place").alias("place"))
    return sure, written(open_, "open")


def open_texts(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """uid, text, and the open occurrences in it."""
    wanted = open_.groupBy("uid").agg(F.collect_list(F.struct("place", "anchor", "n")).alias("open"))
    return texts.select("uid", "text").join(wanted, "uid")


def open_windows(texts: DataFrame, open_: DataFrame, unit: Unit) -> DataFrame:
    """Runs (uid, first, count) of the open windows that occur twice, by exact grouping of all open windows."""

    def make(got, batch, lo, hi, data, offsets):
        flat, doc = listed(batch, lo, hi)
        place, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        order = np.argsort(place + got.bounds[doc], kind="stable")
        rows = pick(got, doc, place)
        of, start, hashed = got.windows(rows)
        owner = got.doc[rows][of]
        uid = batch.column(0).slice(lo, hi - lo).to_numpy()[owner]
        return [pa.array(got.anchor[rows][of].view(np.int64)), pa.array(hashed.view(np.int64)), pa.array(n[order][of]), pa.array(uid), pa.array((start - got.bounds[owner]).astype(np.int32))]

    rows = written(per_suspect(open_texts(texts, open_), "open", unit, "anchor bigint, w bigint, n bigint, uid bigint, first int", make), "windows")
    twice = written(rows.groupBy("anchor", "w").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "w"), "twice")
    return rows.filter("n = 1").join(twice, ["anchor", "w"], "left_semi").select("uid", "first", F.lit(1).alias("count"))


def finish(scanned: DataFrame, texts: DataFrame, runs: DataFrame, unit: Unit, keep_text: bool = False) -> DataFrame:
    """Per input row: id, n_units, n_removed, n_spans, digest of what is kept (and the kept text where units went)."""
    per_doc = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "count")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, runs_ = batch.column(1), batch.column(2)
            removed, spans, digests, kept_texts = [], [], [], []
            for k in range(batch.num_rows):
                raw = texts_[k].as_py().encode()
                part = runs_[k].values
                first, count = (part.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                size = len(raw.split()) if unit.words else len(raw)
                step = np.zeros(size + 1, np.int64)
                np.add.at(step, first, 1)
                np.add.at(step, first + count + unit.window - 1, -1)
                covered = np.cumsum(step[:-1]) > 0
                kept = _kept(raw, unit, covered)
                removed.append(int(covered.sum()))
                spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
                ["uid", "n_removed", "n_spans", "kept_digest", "kept"],
            )

    cut = texts.select("uid", "text").join(per_doc, "uid").mapInArrow(run, "uid bigint, n_removed bigint, n_spans bigint, kept_digest string, kept binary")
    cut = written(cut, "cut")
    out = scanned.select("uid", "id", "n_units", "digest").join(cut, "uid", "left")
    return out.select(
        "uid", "id", "n_units", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_digest", "digest").alias("kept_sha256"), "kept",
    )

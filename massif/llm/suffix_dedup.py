"""Removal of byte strings that occur more than once, by a hash-compared suffix sort.

Suffixes are sampled: every 200-byte string chooses one anchor in it by winnowing, equal
strings choose equal anchors, so sorting the suffixes that begin at repeated anchors is
enough. A mergesort compares two suffixes by binary search for their common extension over
prefix polynomial hashes. In the sorted order the strings that begin ``d`` bytes before the
anchor fall into runs with a common extension of ``200 - d`` bytes; in a run they are equal
when the ``d`` bytes before are. Equal hashes are then verified byte by byte.

Each task sorts a bounded number of contexts. An anchor with more distinct contexts than that
(a passage in a large share of all documents) is decided by exact grouping of its strings
instead, which combines before the shuffle; both ways give the same bytes.

Defined cases: null and empty texts have no bytes; texts shorter than a string lose none; rows
that repeat id and text are documents of their own; a null id is passed through; an empty
table gives no rows. Strings may cut a character: what is kept is bytes. Other columns are
passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm import repeats
from massif.llm.repeats import Unit
from massif.llm.tables import written
from massif.llm.text import _BYTES, Rolling, U, mix

LENGTH = 200
#: Contexts that one task sorts, about; also the most contexts of an anchor that are sorted.
SORT_ROWS = 1 << 14


class Suffixes:
    """Suffixes of a byte buffer: begin and end of each."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.size = np.append(data, np.uint8(0)), begin, end - begin
        self.rolling = Rolling(_BYTES[2][data], 3)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over hashes."""
        a, b = self.begin[x], self.begin[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while True:
            todo = np.flatnonzero(lo < hi)
            if not len(todo):
                return lo
            mid = (lo[todo] + hi[todo] + 1) >> 1
            same = self.rolling.slices(a[todo], a[todo] + mid) == self.rolling.slices(b[todo], b[todo] + mid)
            lo[todo] = np.where(same, mid, lo[todo])
            hi[todo] = np.where(same, hi[todo], mid - 1)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; a prefix sorts first, equal ones by number."""
        n = self.common(x, y)
        x_ends, y_ends = n == self.size[x], n == self.size[y]
        less = self.data[self.begin[x] + np.where(x_ends, 0, n)] < self.data[self.begin[y] + np.where(y_ends, 0, n)]
        return np.where(x_ends & y_ends, x < y, np.where(x_ends, True, np.where(y_ends, False, less)))

    def sorted(self) -> np.ndarray:
        """The suffixes in order: a bottom-up mergesort; all merges of a level are made at once."""
        n = len(self.begin)
        order, run = np.arange(n), 1
        while run < n:
            at = np.arange(n)
            left = (at // run) % 2 == 0
            other = np.where(left, (at // run + 1) * run, (at // run - 1) * run)
            start = np.minimum(other, n)
            lo, hi = start.copy(), np.minimum(other + run, n)
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) >> 1
                goes = self.before(order[mid], order[todo])
                lo[todo] = np.where(goes, mid + 1, lo[todo])
                hi[todo] = np.where(goes, hi[todo], mid)
            base = at // (2 * run) * (2 * run)
            within = at % run
            merged = np.empty_like(order)
            merged[base + within + lo - start] = order
            order, run = merged, run * 2
        return order


def repeated_strings(data: np.ndarray, ends: np.ndarray, left: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which strings of each context occur in another context too: a row per context, a column per start.

    Context i is ``data[ends[i-1]:ends[i]]``, its anchor is ``left[i]`` bytes in, and ``count[i]``
    strings begin at its first bytes.
    """
    n = len(ends)
    begins = np.concatenate([[0], ends[:-1]])
    anchor = begins + left
    found = np.zeros((n, int(count.max())), bool)
    suffixes = Suffixes(data, anchor, ends)
    order = suffixes.sorted()
    shared = np.concatenate([[0], suffixes.common(order[:-1], order[1:])]) if n > 1 else np.zeros(n, np.int64)
    span = np.arange(length)
    padded = suffixes.data
    for d in range(int(left.max()) + 1):
        in_order = (d <= left[order]) & (d > left[order] - count[order])
        run = np.cumsum(shared < length - d)[in_order]
        rows = order[in_order]
        if len(rows) < 2:
            continue
        key = mix(run.astype(U) * U(0x9E3779B97F4A7C15) ^ mix(suffixes.rolling.slices(anchor[rows] - d, anchor[rows])))
        by = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        a, b = rows[by[same]], rows[by[same + 1]]
        for lo in range(0, len(a), 1 << 14):
            x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            equal = (padded[(anchor[x] - d)[:, None] + span] == padded[(anchor[y] - d)[:, None] + span]).all(axis=1)
            if not equal.all():  # a hash collision: these strings are compared as they are
                doubtful = np.isin(key[by], key[by[same[lo : lo + (1 << 14)][~equal]]])
                seen: dict[bytes, list[int]] = {}
                for row in rows[by[doubtful]]:
                    seen.setdefault(padded[anchor[row] - d : anchor[row] - d + length].tobytes(), []).append(int(row))
                for members in seen.values():
                    if len(members) > 1:
                        found[members, left[members] - d] = True
            x, y = x[equal], y[equal]
            found[x, left[x] - d] = True
            found[y, left[y] - d] = True
    return found


def sorted_strings(texts: DataFrame, open_: DataFrame, unit: Unit) -> DataFrame:
    """Runs (uid, first, count) of open strings that occur twice, by suffix sort in bounded tasks."""

    def make(got, batch, lo, hi, data, offsets):
        flat, doc = repeats.listed(batch, lo, hi)
        place, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        order = np.argsort(place + got.bounds[doc], kind="stable")
        rows = repeats.pick(got, doc, place)
        owner, first, count = got.doc[rows], got.first[rows], got.count[rows]
        raw = data.tobytes()
        return [
            pa.array(got.anchor[rows].view(np.int64)), pa.array(n[order]), pa.array(batch.column(0).slice(lo, hi - lo).to_numpy()[owner]),
            pa.array((first - got.bounds[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((got.place[rows] - first).astype(np.int32)),
            pa.array([raw[a : a + c + unit.window - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True)], pa.binary()),
        ]

    def decide(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_numpy() for c in ("n", "uid", "first", "count", "left")}
        whole = table.column("bytes").to_pylist()
        ends = np.cumsum([len(x) for x in whole])
        found = repeated_strings(np.frombuffer(b"".join(whole), np.uint8), ends, column["left"].astype(np.int64), column["count"].astype(np.int64), unit.window)
        found[column["n"] > 1] = False  # those are repeated whole, and known
        step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        return pa.table({"uid": pa.array(column["uid"][row]), "first": pa.array((column["first"][row] + begin).astype(np.int32)), "count": pa.array((stop - begin).astype(np.int32))})

    fields = "anchor bigint, n bigint, uid bigint, first int, count int, left int, bytes binary"
    rows = written(repeats.per_suspect(repeats.open_texts(texts, open_), "open", unit, fields, make), "contexts_open")
    tasks = max(1, -(-rows.count() // SORT_ROWS))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(decide, "uid bigint, first int, count int")


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, sort_rows: int = SORT_ROWS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; where some went and ``keep_text``)."""
    unit = Unit(False, max(1, length * 8 // 25), length)
    keyed = repeats.keyed(docs, id_col, text_col)
    scanned = repeats.scan(keyed, unit)
    texts = repeats.suspects(keyed, scanned)
    sure, open_ = repeats.contexts(repeats.occurrences(texts, unit))
    few = sorted_strings(texts, open_.filter(F.col("contexts") <= sort_rows), unit)
    many = repeats.open_windows(texts, open_.filter(F.col("contexts") > sort_rows), unit)
    out = repeats.finish(scanned, texts, sure.unionByName(few).unionByName(many), unit, keep_text)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept")

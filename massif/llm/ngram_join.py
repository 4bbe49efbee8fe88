"""N-gram Jaccard self-join by prefix trees, with the components of the links.

A document's set of word n-grams is kept as hashes in one global order: n-grams that are
frequent in the corpus last (by a bounded sketch), then by hash. Two sets with the wanted
similarity share one of their first ``n - ceil(t n) + 1`` n-grams, so sets are dealt by these
to tasks. A task stores its sets in a trie; a probe walks all branches at once, level by level,
with the overlap counted so far shared by everything below a branch, and leaves a branch when
its overlap plus what can still come (the shorter of what remains of both) is too small.

Equal sets are one class from the start. A first round deals every class by its first three
shared n-grams only and joins components. In the second round only n-grams that still
belong to several components are looked at, all of them, so no link between components is
missed, while a group of thousands of near copies is not compared pair by pair again. An n-gram of a prefix
counts only where, by its place and the sizes, it can be the first that two similar sets share (``_meeting``). In both rounds
counts go to the tasks first, a byte for two to four n-grams of a set, and a whole set follows only if by the counts
there it can be similar to one of another component (``alike``). Its text is read again for that; rows whose hash
is not in a bitmap of the wanted ones, of fixed size, are passed over. Groups above a task's size are dealt in blocks
and pairs of blocks.

Set sizes and the digests of classes are taken from the whole 64-bit hashes. Stored sets and
prefixes have 56-bit hashes, seven bytes each: among n n-grams of a set or of two compared sets
about n * n / 2**57 collide (one million: one set in 140,000).

Defined cases: null, empty or blank texts have an empty set and no link; a text of fewer words
is one n-gram; a null id is passed through and is the smallest only among nulls; rows that
repeat are equal sets; an empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.components import connected
from massif.llm.repeats import keyed
from massif.llm.tables import discard, fresh, written
from massif.llm.text import Rolling, U, Words, mix, text_chunks

SKETCH_BITS = 22
HASH_BITS = 56
SKETCH_FLUSH = 1 << 22
#: An n-gram is reported to the sketch by a task that meets it so often in one go.
SKETCH_LEAST = 8
FIRST_TOKENS = 3
TASK_SETS = 1500
TASK_NGRAMS = 4_000_000
#: N-grams that share a first member share a task up to so many times a task's sets.
LED_ROWS = 8
SEGMENT = 64
#: Places in which the n-grams of a set are counted: so many at least, and one for two to four n-grams.
LEAST_PLACES = 16
#: Bits of the map of rows whose sets are made again, 2**25: 4 MB at any input size.
MAP_BITS = 25


def _grams(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a chunk's documents, and where each document's begin."""
    words = Words(data, offsets, lower=True)
    bounds = words.bounds
    counts = np.diff(bounds)
    rolling = Rolling(words.hashes(), 4)
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(per_doc)])
    first = np.repeat(bounds[:-1] - starts[:-1], per_doc) + np.arange(starts[-1])
    length = np.repeat(np.minimum(counts, size), per_doc)
    return mix(rolling.slices(first, first + length) ^ length.astype(U)), starts


def _keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The place of n-grams in the global order: their level, then their hash (which names the slot of the level)."""
    return levels[(hashes & U((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(U) << U(HASH_BITS) | hashes


def _packed(keys: np.ndarray) -> bytes:
    return (keys & U((1 << HASH_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes()


def _unpacked(raw: bytes, levels: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) * 8 // HASH_BITS, 8), np.uint8)
    wide[:, : HASH_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BITS // 8)
    return _keys(wide.view("<u8").ravel(), levels)


def _distinct(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's distinct n-grams as whole hashes."""
    grams, starts = _grams(data, offsets, size)
    return [np.unique(grams[a:b]) for a, b in zip(starts, starts[1:], strict=False)]


def _ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A document's n-grams in the global order."""
    return np.unique(_keys(grams & U((1 << HASH_BITS) - 1), levels))


def _sets(data: np.ndarray, offsets: np.ndarray, size: int, levels: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct n-grams in the global order."""
    grams, starts = _grams(data, offsets, size)
    return [_ordered(grams[a:b], levels) for a, b in zip(starts, starts[1:], strict=False)]


def _places(size: int) -> int:
    return max(LEAST_PLACES, 1 << max(0, (size // 2).bit_length() - 1))


def _counted(keys: np.ndarray, size: int) -> bytes:
    """How many of a set's n-grams fall in each place by their last bits, modulo 256."""
    places = _places(size)
    return np.bincount((keys & U(places - 1)).astype(np.int64), minlength=places).astype(np.uint8).tobytes()


def frequency_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each of the sketch's slots, the bit length of how often frequent n-grams fell there: 2**22 bytes, at any input size."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= SKETCH_LEAST
            slots, of = np.unique((grams[often] & U((1 << SKETCH_BITS) - 1)).astype(np.int64), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.bincount(of, n[often], len(slots)).astype(np.int64))], ["slot", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                held.append(_grams(data, offsets, size)[0])
                total += len(held[-1])
                if total > SKETCH_FLUSH:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    slots = docs.select("text").mapInArrow(sketch, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = slots.toArrow()  # at most 2**22 rows of two numbers
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    if table.num_rows:
        levels[table.column("slot").to_numpy()] = np.log2(table.column("n").to_numpy()).astype(np.uint8) + 1
    return levels


class Trie:
    """Distinct ordered sets as a compressed prefix tree, numbered level by level.

    A node holds a run of at most ``SEGMENT`` codes. Arrays by node: parent, depth after the
    run, last code, the set that ends there (or -1), smallest and largest set size below.

    With ``sizes`` the sequences are only the first elements of sets of these sizes; partners are
    then all sets that can be similar by what is known.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        lengths = np.array([len(s) for s in sets], np.int64)
        self.sizes = lengths if sizes is None else sizes
        codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.n_codes = len(codes)
        self.known = np.split(flat.astype(np.int32), np.cumsum(lengths)[:-1])
        # beginnings may be equal: a mark of its own, above all codes, ends each sequence
        self.sets = self.known if sizes is None else [np.append(s, np.int32(self.n_codes + 1 + i)) for i, s in enumerate(self.known)]
        raw = [s.astype(">i4").tobytes() for s in self.sets]
        order = sorted(range(len(sets)), key=raw.__getitem__)
        parent, start, stop, owner, ends = [], [], [], [], []
        path: list[int] = []  # nodes from the root to the last set's end
        last = None
        for i in order:
            mine = self.sets[i]
            shared = 0
            if last is not None:
                k = min(len(mine), len(self.sets[last]))
                differ = np.flatnonzero(mine[:k] != self.sets[last][:k])
                shared = int(differ[0]) if len(differ) else k
            while path and start[path[-1]] >= shared:
                path.pop()
            if path and stop[path[-1]] > shared:  # the last set's node is divided where the two part
                node = path[-1]
                parent.append(parent[node])
                start.append(start[node])
                stop.append(shared)
                owner.append(owner[node])
                ends.append(-1)
                upper = len(parent) - 1
                parent[node], start[node] = upper, shared
                path[-1] = upper
            at = shared
            while at < len(mine):
                to = min(at + SEGMENT, len(mine))
                parent.append(path[-1] if path else -1)
                start.append(at)
                stop.append(to)
                owner.append(i)
                ends.append(-1)
                path.append(len(parent) - 1)
                at = to
            ends[path[-1]] = i
            last = i
        n = len(parent)
        parent_, level = np.array(parent, np.int64), np.full(n, -1, np.int64)
        level[parent_ < 0] = 0
        while (level < 0).any():
            open_ = np.flatnonzero(level < 0)
            above = level[parent_[open_]]
            level[open_[above >= 0]] = above[above >= 0] + 1
        by = np.lexsort((parent_, level))  # level by level, children of a node together once parents are renumbered
        place = np.empty(n, np.int64)
        for lv in range(int(level.max()) + 1):
            rows = np.flatnonzero(level[by] == lv)
            if lv:
                by[rows] = by[rows][np.argsort(place[parent_[by[rows]]], kind="stable")]
            place[by[rows]] = rows
        self.level_end = np.searchsorted(level[by], np.arange(level.max() + 2))
        self.parent = np.where(parent_[by] < 0, -1, place[parent_[by]])
        self.depth = np.array(stop, np.int64)[by]
        self.ends = np.array(ends, np.int64)[by]
        self.codes = np.full((n, SEGMENT), self.n_codes, np.int32)
        for row, node in enumerate(by):
            part = self.known[owner[node]][start[node] : stop[node]]
            self.codes[row, : len(part)] = part
        self.last = np.array([self.known[owner[node]][min(stop[node], len(self.known[owner[node]])) - 1] for node in by], np.int64)
        self.least, self.most = np.full(n, 1 << 60, np.int64), np.zeros(n, np.int64)
        done = self.ends >= 0
        self.least[done] = self.most[done] = self.sizes[self.ends[done]]
        for lv in range(len(self.level_end) - 2, 0, -1):
            rows = slice(self.level_end[lv], self.level_end[lv + 1])
            np.minimum.at(self.least, self.parent[rows], self.least[rows])
            np.maximum.at(self.most, self.parent[rows], self.most[rows])
        kids = np.bincount(self.parent[self.parent >= 0], minlength=n)
        self.kids = kids
        first = np.full(n, 0, np.int64)
        below = np.flatnonzero(self.parent >= 0)
        if len(below):
            heads = below[np.concatenate([[True], self.parent[below][1:] != self.parent[below][:-1]])]
            first[self.parent[heads]] = heads
        self.first_kid = first
        self.mark = np.zeros(self.n_codes + 1, bool)

    def partners(self, r: int, num: int, den: int) -> np.ndarray:
        """Sets not larger than set r with den * overlap >= num * union, r itself left out."""
        mine, size = self.known[r], int(self.sizes[r])
        smallest = -(-num * size // den)
        self.mark[mine] = True
        nodes = np.arange(self.level_end[1])
        before = seen = np.zeros(len(nodes), np.int64)
        found = []
        while len(nodes):
            codes = self.codes[nodes]
            overlap = before + self.mark[codes].sum(axis=1)
            # what both may still have in common: elements after the last one known of either
            passed = seen + (codes <= mine[-1]).sum(axis=1)
            left = size - np.searchsorted(mine, self.last[nodes], side="right")
            rest = np.minimum(left, self.most[nodes] - passed)
            need = num * (size + np.maximum(self.least[nodes], smallest))
            alive = ((overlap + rest) * (num + den) >= need) & (self.most[nodes] >= smallest) & (self.least[nodes] <= size)
            nodes, overlap, passed, left = nodes[alive], overlap[alive], passed[alive], left[alive]
            done = self.ends[nodes] >= 0
            other = self.ends[nodes[done]]
            rest = np.minimum(left[done], self.sizes[other] - passed[done])
            hit = (den + num) * (overlap[done] + rest) >= num * (size + self.sizes[other])
            found.append(other[hit & (self.sizes[other] <= size) & (other != r)])
            kids = self.kids[nodes]
            before, seen = np.repeat(overlap, kids), np.repeat(passed, kids)
            nodes = np.repeat(self.first_kid[nodes] - np.cumsum(kids) + kids, kids) + np.arange(kids.sum())
        self.mark[mine] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def trie_links(sets: list[np.ndarray], group: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets that connect everything connected here; ``group`` numbers what is connected already."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = len(sets)
    first: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):
        if first.setdefault(g, i) != i:
            parent[i] = first[g]
            left -= 1
    if left < 2:
        return []
    trie = Trie(sets)
    links = []
    for r in np.argsort(trie.sizes, kind="stable")[::-1].tolist():
        for s in trie.partners(r, num, den).tolist():
            a, b = find(r), find(s)
            if a != b:
                parent[a] = b
                links.append((r, s))
                left -= 1
        if left < 2:
            break
    return links


def possible(sets: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets, known by their first elements in order, can be similar to one of another group.

    Similar sets share a first element, so the pairs come from lists of the sets that have each. Up to the
    lesser of two last known elements both are known; of what follows, the shorter rest can be in common.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(sets)), lengths)
    placed = owner * len(codes) + flat  # ascends: set after set, each in order
    by = np.argsort(flat, kind="stable")
    members, starts = owner[by], np.searchsorted(flat[by], np.arange(len(codes) + 1))
    several = np.diff(starts) > 1
    last = flat[bounds[1:] - 1]
    out = np.zeros(len(sets), bool)
    for r in range(len(sets)):
        mine = flat[bounds[r] : bounds[r + 1]]
        shared = mine[several[mine]].tolist()
        if not shared:
            continue
        count = np.bincount(np.concatenate([members[starts[c] : starts[c + 1]] for c in shared]), minlength=len(sets))
        near = np.flatnonzero(count)
        near = near[group[near] != group[r]]
        overlap = count[near]
        rest = np.minimum(
            sizes[r] - np.searchsorted(mine, last[near], side="right"),
            sizes[near] - (np.searchsorted(placed, near * len(codes) + last[r], side="right") - bounds[near]),
        )
        near = near[(overlap + rest) * (num + den) >= num * (sizes[r] + sizes[near])]
        if len(near):
            out[r] = out[near] = True
    return out


def _meeting(rows: DataFrame, num: int, den: int, task_sets: int) -> DataFrame:
    """Rows (token, node, n, pos; c of them have the token) whose n-gram can be the first that similar sets share.

    Before the first common n-gram nothing is in common, so at places i and j the overlap is at most the lesser of
    n - i and m - j. That must be ``num / (num + den) * (n + m)``: m is at most the ``reach`` of the one, n at most that of the
    other. So in order of size an earlier row must reach as far as this one, or the next one must be within its
    reach. Of groups above a task's size all rows stay: their parts do not know each other.
    """
    many = F.col("c") > task_sets
    by = W.partitionBy("token", F.when(many, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / task_sets))).otherwise(F.lit(0))).orderBy("n")
    known = rows.withColumn("reach", F.floor((F.col("n") - F.col("pos")) * (num + den) / num) - F.col("n"))
    known = known.withColumn("before", F.max("reach").over(by.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.lead("n").over(by))
    return known.filter(many | (F.col("before") >= F.col("n")) | (F.col("after") <= F.col("reach"))).drop("c", "reach", "before", "after")


def alike(counts: list[bytes], sizes: np.ndarray, group: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets can be similar to one of another group, by their numbers of n-grams in each place (``_counted``).

    N-grams that only one of two sets has are at least as many as their counts differ, all places together. That also holds
    for differences modulo 256, taken the shorter way, and for the sums of places in halves, so sets with more places are
    compared with sets with fewer. Similar sets have at most ``(den - num) / (den + num) * (n + m)`` such n-grams.
    """
    by = np.argsort(sizes, kind="stable")
    sizes, group = sizes[by], group[by]
    width = np.array([len(counts[i]) for i in by], np.int64)  # ascends with the size
    tables: dict[int, tuple[int, int, np.ndarray]] = {}  # places -> first set, end of those that have no more, and the counts from there on
    table = None
    for places in np.unique(width)[::-1].tolist():
        while table is not None and table.shape[1] > places:
            table = table[:, : table.shape[1] // 2] + table[:, table.shape[1] // 2 :]
        first, end = np.searchsorted(width, [places, places + 1]).tolist()
        own = np.frombuffer(b"".join(counts[i] for i in by[first:end]), np.uint8).reshape(-1, places)
        table = own if table is None else np.concatenate([own, table])
        tables[places] = first, end, table
    low = np.searchsorted(sizes, -(-num * sizes // den)).tolist()
    high = np.searchsorted(sizes, den * sizes // num, side="right").tolist()
    found = np.zeros(len(by), bool)
    for r in np.flatnonzero(sizes).tolist():
        if found[r]:
            continue  # sets that have not been found yet look for this one themselves
        for places, (first, end, table) in tables.items():
            start, stop = max(low[r], first), high[r] if places == width[r] else min(high[r], end)
            if places > width[r] or start >= stop:
                continue
            near = start + np.flatnonzero(group[start:stop] != group[r])
            apart = np.abs((table[near - first] - table[r - first]).view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int64)
            near = near[apart * (den + num) <= (sizes[near] + sizes[r]) * (den - num)]
            if len(near):
                found[r] = found[near] = True
    out = np.zeros(len(by), bool)
    out[by] = found
    return out


def _possible_tasks(dealt: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``dealt`` whose set can be similar to one of another component in its task, by the counts alone."""

    def check(table: pa.Table) -> pa.Table:
        keep = alike(table.column("counts").to_pylist(), table.column("n").to_numpy(), table.column("part").to_numpy(), num, den)
        return table.select(["task", "node", "part"]).filter(pa.array(keep))

    return dealt.distinct().join(counts, "node").groupBy("task").applyInArrow(check, "task bigint, node bigint, part bigint")


def _row_map(rows: DataFrame) -> np.ndarray:
    """A bit for the last bits of the hash of each row's ``id`` and ``tkey``, in 64-bit numbers."""
    key = F.xxhash64("id", "tkey")
    bits = rows.select(F.shiftright(key.bitwiseAND(F.lit((1 << MAP_BITS) - 1)), 6).alias("at"), key.alias("key")).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits"))
    table = bits.toArrow()  # at most 2**19 rows of two numbers
    out = np.zeros(1 << (MAP_BITS - 6), U)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(U)
    return out


def _mapped(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in the map: all that were put in it, and a few others."""
    last = keys.view(U) & U((1 << MAP_BITS) - 1)
    return (bits[last >> U(6)] >> (last & U(63)) & U(1)).astype(bool)


def _join_tasks(dealt: DataFrame, sets: DataFrame, levels, num: int, den: int) -> DataFrame:
    """Links (u, v) of the sets that meet in a task: ``dealt`` has task, node, part (its component)."""

    def links(table: pa.Table) -> pa.Table:
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        found = trie_links([_unpacked(x, levels.value) for x in table.column("keys").to_pylist()], part, num, den)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(part[at[:, 0]]), "v": pa.array(part[at[:, 1]])})

    return dealt.distinct().join(sets, "node").groupBy("task").applyInArrow(links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", task_sets: int = TASK_SETS) -> DataFrame:
    """One row per input row: id, n_shingles, class_size, component_id, uid, component, tkey.

    Two documents link when ``den * |intersection| >= num * |union|`` of their n-gram sets.
    ``component_id`` is the smallest id reachable by links; ``component`` names the component
    without regard to ids, ``uid`` the row, and ``tkey`` the hash of its text.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    levels = spark.sparkContext.broadcast(frequency_levels(rows, words))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                whole = _distinct(data, offsets, words)
                sizes = np.array([len(s) for s in whole], np.int64)
                flat = np.concatenate(whole)
                sets = [_ordered(s, levels.value) for s in whole]
                at = np.concatenate([[0], np.cumsum(sizes)])
                digests = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.concatenate([[U(0)], np.cumsum(mix(flat ^ U(salt)))]).astype(U)
                    digests.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
                counts = pa.array([_counted(s, n) for s, n in zip(sets, sizes.tolist(), strict=True)], pa.binary())
                heads = [s[: len(s) - -(-num * len(s) // den) + 1] if len(s) else s for s in sets]
                prefix = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)), pa.array(np.concatenate(heads).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(sizes), *digests, counts, prefix],
                    ["id", "tkey", "n", "d1", "d2", "counts", "prefix"],
                )

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("tkey bigint, n bigint, d1 bigint, d2 bigint, counts binary, prefix array<bigint>").fields])
    described = rows.select("id", "text", "tkey").mapInArrow(describe, schema).withColumn("uid", F.monotonically_increasing_id())
    described = written(described, "sets")

    classes = described.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("uid").alias("node"), F.count("*").alias("class_size"))
    classes = written(classes, "classes")
    reps = described.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    heads = written(reps.select(F.col("uid").alias("node"), "n", F.posexplode("prefix").alias("pos", "token")), "prefixes")
    shared = written(heads.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", "c"), "shared")
    tokens = written(_meeting(heads.join(shared, "token"), num, den, task_sets), "tokens")
    discard(heads)

    repeated = not described.groupBy("id", "tkey").count().filter("count > 1").isEmpty()

    def whole_sets(tasks: DataFrame) -> DataFrame:
        """The whole sets of the classes that stand in a task: texts are read again, and only sets of wanted rows are made and shuffled."""
        wanted = written(tasks.select(F.col("node").alias("uid")).distinct().join(described.select("uid", "id", "tkey"), "uid"), "wanted")
        bits = spark.sparkContext.broadcast(_row_map(wanted))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_mapped(batch.column(3).to_numpy(), bits.value)))
                for lo, hi, data, offsets in text_chunks(batch.column(1)):
                    sets = _sets(data, offsets, words, levels.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([_packed(s) for s in sets], pa.binary())], ["own", "own_key", "keys"])

        schema = T.StructType([T.StructField("own", rows.schema["id"].dataType), *T._parse_datatype_string("own_key bigint, keys binary").fields])
        made = rows.select("id", "text", "tkey", F.xxhash64("id", "tkey").alias("row")).mapInArrow(whole, schema)
        met = made.join(wanted, (F.col("own_key") == F.col("tkey")) & F.col("own").eqNullSafe(F.col("id"))).select(F.col("uid").alias("node"), "keys")
        return written(met.dropDuplicates(["node"]) if repeated else met, "keys")

    def linked(members: DataFrame, pairs: bool) -> DataFrame:
        """(node, root) of the links between members; only sets that can be similar by their counts are made whole and dealt."""
        tasks = written(_possible_tasks(dealt(members, pairs), known, num, den), "possible")
        sets = whole_sets(tasks)
        found = written(connected(_join_tasks(tasks, sets, levels, num, den)), "linked")
        discard(sets)
        return found

    def dealt(members: DataFrame, pairs: bool) -> DataFrame:
        """Tasks of about ``task_sets`` sets; a larger group of one n-gram goes in blocks, or in all pairs of blocks.

        N-grams with the same first member mostly have the same members (they stand in one
        passage or one group of copies), so they share a task and a set goes there once.
        """
        groups = members.groupBy("token").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("node").alias("lead")).filter("c > 1")
        half = 2 if pairs else 1
        blocks = F.greatest(F.ceil(F.col("c") * half / task_sets), F.ceil(F.col("total") * half / TASK_NGRAMS))
        groups = written(groups.select("token", "c", "lead", F.when((F.col("c") > task_sets) | (F.col("total") > TASK_NGRAMS), blocks).otherwise(F.lit(1)).cast("bigint").alias("blocks")), "groups")
        led = groups.groupBy("lead").agg(F.sum("c").alias("led"))
        at = F.when(F.col("led") <= LED_ROWS * task_sets, F.xxhash64(F.lit(1), "lead")).otherwise(F.xxhash64(F.lit(2), "token"))
        groups = written(groups.join(led, "lead").select("token", "blocks", at.alias("at")), "places")
        placed = members.join(groups, "token").withColumn("mine", F.pmod(F.xxhash64("node", "token"), F.col("blocks")))
        if pairs:
            placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            placed = placed.withColumn("mine_", F.least("mine", "other")).withColumn("other", F.greatest("mine", "other")).drop("mine").withColumnRenamed("mine_", "mine")
        else:
            placed = placed.withColumn("other", F.col("mine"))
        placed = written(placed.select("token", "at", "mine", "other", "blocks", "node", "part", "n"), "dealt")
        sent = placed.select("at", "mine", "other", "node", "n").distinct()
        size = sent.agg(F.count("*"), F.sum("n")).first()
        tasks = max(1, -(-int(size[0]) // task_sets), -(-int(size[1] or 0) // TASK_NGRAMS))
        small = F.pmod(F.col("at"), F.lit(tasks))
        big = F.xxhash64("token", "mine", "other").bitwiseOR(F.lit(1 << 62))  # a task of its own
        return placed.select(F.when(F.col("blocks") > 1, big).otherwise(small).alias("task"), "node", "part")

    rank = F.row_number().over(W.partitionBy("node").orderBy("pos"))
    first = tokens.withColumn("rank", rank).filter(F.col("rank") <= FIRST_TOKENS).select("token", "node", "n", F.col("node").alias("part"))
    known = described.select(F.col("uid").alias("node"), "n", "counts")
    near = linked(first, False)

    found = tokens.join(near, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("part"))
    found = written(found, "parts")
    cross = found.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("token")
    rest = found.join(cross, "token", "left_semi")
    far = linked(rest, True)
    for table in (tokens, found):
        discard(table)

    roots = classes.join(near, "node", "left").withColumn("mid", F.coalesce("root", "node")).drop("root")
    roots = roots.join(far.select(F.col("node").alias("mid"), "root"), "mid", "left").withColumn("component", F.coalesce("root", "mid"))
    roots = written(roots.select("d1", "d2", "n", "class_size", "component"), "roots")
    placed = described.select("uid", "id", "tkey", "n", "d1", "d2").join(roots, ["d1", "d2", "n"], "left")
    placed = written(placed.select("uid", "id", "tkey", "n", F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"), F.coalesce("component", "uid").alias("component")), "placed")
    least = written(placed.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    return placed.join(least, "component").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_size", "component_id", "uid", "component", "tkey")


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that with the smallest id (nulls last), with all its columns.

    Rows are told apart by id and text, so null and repeated ids do no harm; of rows that repeat
    both, one stays. Texts without an n-gram have no link: all such rows stay.
    """
    found = near_duplicates(docs, words, num, den, id_col, text_col).filter("n_shingles > 0")
    i, t = fresh("id", docs), fresh("text", docs)
    found = written(found.select(F.col(id_col).alias(i), F.col("tkey").alias(f"{t}_k"), "component"), "linked")
    first = found.groupBy("component").agg(F.min(F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(f"{t}_k").alias("key"))).alias("first"))
    first = written(first, "first")
    other = ~F.col(i).eqNullSafe(F.col("first.id")) | (F.col(f"{t}_k") != F.col("first.key"))
    gone = written(found.join(first, "component").filter(other).select(i, f"{t}_k").distinct(), "gone")
    match = (F.col(t) == F.col(f"{t}_k")) & F.col(id_col).eqNullSafe(F.col(i))
    left = docs.withColumn(t, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(gone, match, "left_anti")
    repeats = written(found.groupBy(i, f"{t}_k").count().filter("count > 1").select(i, f"{t}_k"), "repeats")
    if repeats.isEmpty():
        return left.drop(t)
    single = left.join(repeats, match, "left_anti")
    return single.unionByName(left.join(repeats, match, "left_semi").dropDuplicates([t, id_col])).drop(t)

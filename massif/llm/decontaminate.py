"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of 16, 32 and 48 words that begin every ``STEP`` words; an item is
compared with the passages nearest to its length. Hashed TF-IDF rows of all passages are reduced by a randomised singular value decomposition: every task multiplies
its rows with a fixed random matrix and back (one pass), the sums of all tasks are a matrix of
bounded size, and its single-pass Nystroem form gives singular vectors and values. In the
latent space every passage is compared with every benchmark passage by cosine, in
blocks of benchmark items. Short items and items of frequent words alone are diluted there by their
neighbours, so all items are also looked for exactly: every place that has ``GRAM`` words of an item
in a row (all of them, if it has fewer) is a candidate. Candidates are then checked on the words themselves:
the longest common subsequence of the item and the text around the passage must cover ``LCS_SHARE``
of the item, and ``ANSWER_SHARE`` of its last words, the answer.

Words are runs of letters and digits; in scripts that are written without blanks (Chinese, Japanese,
Thai, Lao, Burmese, Khmer) every character is a word.

Defined cases: null and empty texts and items, and items without a letter or digit, match nothing;
items of fewer than ``least_words`` words are passed over (1 keeps all: an item of one common word
matches every document that has it); rows that repeat match alike; a null id is passed through;
empty tables give no rows. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tables import fresh, written
from massif.llm.text import Rolling, U, Words, mix, text_chunks
from massif.llm.toxicity import LETTERS

STEP = 8
#: Passage lengths in steps; the middle one is decomposed.
SIZES = (2, 4, 6)
SLOT_BITS = 13
IDF_POWER = 3
RANK = 96
COSINE = 0.5
LCS_SHARE = 0.6
ANSWER_SHARE = 0.5
#: Items of fewer words are passed over unless the caller asks for them; the queries ask for all.
LEAST_WORDS = 8
#: Words in a row that make a place a candidate for an item.
GRAM = 5
#: Bits of a gram's hash looked at before the search in the items' grams.
GRAM_BITS = 20
#: Benchmark items compared in one pass over the documents.
BLOCK_ITEMS = 2000
SUM_ROWS = 128
LONG_RUN = 64


def _unspaced() -> np.ndarray:
    """Whether a character's first two UTF-8 bytes (as one number) are those of a script written without blanks."""
    out = np.zeros(1 << 16, bool)
    # Thai and Lao, Burmese, Khmer, kana and CJK up to U+9FFF, compatibility and full-width forms, U+20000 and above
    for first, last in ((0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBE), (0xF0A0, 0xF0BF)):
        out[first : last + 1] = True
    return out


UNSPACED = _unspaced()


def _characters(data: np.ndarray) -> np.ndarray:
    """Where the characters of unspaced scripts begin and end in UTF-8 bytes."""
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    lead = lead[UNSPACED[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
    return np.concatenate([lead, lead + np.where(data[lead] >= 0xF0, 4, 3)])


def _run_sums(groups: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, sum of ``rows[picked]``) of every run of equal groups.

    The first members of all runs are added at once, then the second ones, and so on, longer
    runs first; what runs longer than ``LONG_RUN`` have left is added run by run.
    """
    if not len(groups):
        return groups[:0], rows[:0]
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    count = np.diff(np.append(heads, len(groups)))
    by = np.argsort(-count, kind="stable")
    heads, count = heads[by], count[by]
    total = rows[picked[heads]]
    for k in range(1, min(int(count[0]), LONG_RUN)):
        n = int(np.searchsorted(-count, -k, side="left"))
        total[:n] += rows.take(picked[heads[:n] + k], axis=0)
    for i in range(int(np.searchsorted(-count, -LONG_RUN, side="left"))):
        total[i] += rows[picked[heads[i] + LONG_RUN : heads[i] + count[i]]].sum(axis=0)
    return groups[heads], total


class Passages:
    """A chunk's words as slots and hashes, and its steps of ``STEP`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True, letters=LETTERS, cuts=_characters(data))
        self.bounds = words.bounds
        self.hashes = words.hashes()
        self.slots = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
        count = np.diff(self.bounds)
        self.steps = -(-count // STEP)
        self.step_base = np.concatenate([[0], np.cumsum(self.steps)])
        self.within = np.arange(self.step_base[-1]) - np.repeat(self.step_base[:-1], self.steps)
        self.step_start = np.repeat(self.bounds[:-1], self.steps) + STEP * self.within
        self.step_doc = np.repeat(np.arange(len(count)), self.steps)
        self.step_of = np.repeat(np.arange(len(self.step_start)), np.diff(np.append(self.step_start, self.bounds[-1])))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``size`` words inside one document."""
        first = np.arange(max(0, len(self.hashes) - size + 1))
        end = np.repeat(self.bounds[1:], np.diff(self.bounds))[: len(first)]
        first = first[first + size <= end]
        return first, mix(Rolling(self.hashes, 4).slices(first, first + size) ^ U(size))

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Per step, the sum of its words' rows: all first words are added at once, then all second ones, and so on."""
        out = np.zeros((len(self.step_start), rows.shape[1]), rows.dtype)
        size = np.diff(np.append(self.step_start, self.bounds[-1]))
        full = size == STEP
        first, total = self.step_start[full], np.zeros((int(full.sum()), rows.shape[1]), rows.dtype)
        more = np.empty_like(total)
        for k in range(STEP):
            total += rows.take(self.slots[first + k].astype(np.int64), axis=0, out=more, mode="clip")
        out[full] = total
        step, total = _run_sums(self.step_of[~full[self.step_of]], rows, self.slots[~full[self.step_of]])
        out[step] = total
        return out

    def starts(self, size: int) -> np.ndarray:
        """First steps of the passages of ``size`` steps; a shorter document is one passage."""
        left = np.repeat(self.steps, self.steps) - self.within
        return np.flatnonzero((left >= size) | (self.within == 0))

    def whole(self, sums: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[int, np.ndarray]]:
        """(size, sum over its steps per passage of ``size`` steps) of ascending sizes; one sum grows step by step."""
        out, n = sums.copy(), len(sums)
        for size, before in zip(sizes, (1, *sizes), strict=False):
            for k in range(before, size):
                out[: max(0, n - k)] += sums[k:]
            first = self.starts(size)
            total = out[first]
            # a document of fewer steps
            short = np.flatnonzero(self.steps[self.step_doc[first]] < size)
            total[short] = sums[first[short]]
            for k in range(1, size):
                more = short[k < self.steps[self.step_doc[first[short]]]]
                total[more] += sums[first[more] + k]
            yield size, total


def idf_weights(docs: DataFrame) -> np.ndarray:
    """Weight of every slot by inverse document frequency: 2**13 numbers, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_docs = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                got = Passages(data, offsets)
                doc = np.repeat(np.arange(hi - lo), np.diff(got.bounds))
                held = np.sort(doc << SLOT_BITS | got.slots.astype(np.int64))
                held = held[np.concatenate([[True], held[1:] != held[:-1]])[: len(held)]]
                total += np.bincount(held & ((1 << SLOT_BITS) - 1), minlength=len(total))
                n_docs += hi - lo
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n_docs))], ["slot", "n"])

    table = docs.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = (table.column(c).to_numpy() for c in ("slot", "n"))
    seen = np.zeros(1 << SLOT_BITS)
    seen[slots[slots >= 0]] = n[slots >= 0]
    # a power: words of every second sentence say little about which passage it is
    return (np.log((n[slots < 0].sum() + 1) / (seen + 1)) + 0.05) ** IDF_POWER


def latent_space(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Slots by ``rank``: maps a passage's slot counts to latent coordinates, half whitened."""
    size = 1 << SLOT_BITS
    test = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf.astype(np.float32), test))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, test = shared.value
        rows = np.column_stack([test * weight[:, None], weight**2])
        total = np.zeros((size, rank), np.float64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                got = Passages(data, offsets)
                # disjoint passages
                if not len(got.step_start):
                    continue
                head = got.within % SIZES[1] == 0
                sums, first = got.sums(rows), np.flatnonzero(head)
                count, rest = np.diff(np.append(first, len(sums))), np.zeros((len(first), sums.shape[1]), sums.dtype)
                for k in range(1, SIZES[1]):
                    more = count > k
                    rest[more] += sums[first[more] + k]
                sums = sums[first] + rest
                product = sums[:, :rank] / np.maximum(sums[:, rank:], 1e-9)
                order = np.argsort(got.slots, kind="stable")
                of_word = (np.cumsum(head) - 1)[got.step_of]
                slots, sums = _run_sums(got.slots[order], product, of_word[order])
                total[slots] += sums * weight[slots][:, None]
        part = TaskContext.get().partitionId()
        cuts = range(0, size, SUM_ROWS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cuts))), pa.array(np.full(len(cuts), part)), pa.array([total[i : i + SUM_ROWS].astype(np.float32).tobytes() for i in cuts], pa.binary())], ["cut", "part", "sums"]
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"cut": table.column("cut").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kind = "cut bigint, part bigint, sums binary"
    sums = docs.select("text").mapInArrow(multiply, kind).withColumn("part", F.pmod("part", F.lit(64)))
    sums = sums.groupBy("cut", "part").applyInArrow(add, kind).groupBy("cut").applyInArrow(add, kind)
    image = np.zeros((size, rank))
    for row in sums.collect():  # size * rank numbers
        image[row["cut"] * SUM_ROWS : (row["cut"] + 1) * SUM_ROWS] = np.frombuffer(row["sums"], np.float32).reshape(-1, rank)
    core = test.T.astype(np.float64) @ image
    core = (core + core.T) / 2
    core += np.eye(rank) * (1e-6 * max(np.trace(core), 1e-9) / rank)
    values, vectors = np.linalg.eigh(core)
    factor = image @ (vectors / np.sqrt(np.maximum(values, 1e-12)))
    left, scale, _ = np.linalg.svd(factor, full_matrices=False)
    return (left / np.sqrt(np.maximum(scale, scale[0] * 1e-3 + 1e-12)) * idf[:, None]).astype(np.float32)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, all positions of the item in one integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for place in filter(None, map(places.get, text)):
        hit = row & place
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark items: words, latent vectors by passage size, and the item of each vector.

    An item longer than the longest passage is a row of passages itself. ``grams`` has, by length,
    the sorted hashes of the items' grams, with the item and the place in it, and a table of
    their leading bits.
    """

    def __init__(self, ids: list[int], texts: list[str], space: np.ndarray, least_words: int = LEAST_WORDS):
        self.ids, self.words = [], []
        self.latent: list[np.ndarray] = []
        grams: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held: dict[int, tuple[list, list]] = {size: ([], []) for size in SIZES}
        for item, text in zip(ids, texts, strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            got = Passages(raw, np.array([0, len(raw)]))
            n = len(got.hashes)
            if n < max(1, least_words):
                continue
            self.latent.append(_unit(space[got.slots].sum(axis=0, keepdims=True))[0])
            first, hashes = got.grams(min(n, GRAM))
            grams.setdefault(min(n, GRAM), []).append((hashes, np.full(len(first), len(self.ids)), first))
            size = min(SIZES, key=lambda s: abs(s * STEP - n))
            whole = n <= SIZES[-1] * STEP * 4 // 3
            z = space[got.slots].sum(axis=0, keepdims=True) if whole else next(got.whole(got.sums(space), (size,)))[1]
            held[size][0].append(z)
            held[size][1].extend([len(self.ids)] * len(z))
            self.ids.append(item)
            self.words.append(got.hashes.tolist())
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.has = np.zeros((len(self.ids), 1 << SLOT_BITS), bool)
        for i, w in enumerate(self.words):
            self.has[i, (np.array(w, np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
        self.by_size = {size: (_unit(np.concatenate(z)), np.array(owner, np.int64)) for size, (z, owner) in held.items() if z}
        self.grams = {}
        for size, parts in grams.items():
            hashes, owner, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << GRAM_BITS, bool)
            known[(hashes >> U(64 - GRAM_BITS)).astype(np.int64)] = True
            self.grams[size] = (hashes[by], owner[by], place[by], known)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def _region(at, size, n, b0, b1):
    """The words around a passage in which an item of ``n`` words is looked for."""
    reach = n // 2 + STEP
    return np.maximum(b0, at - reach), np.minimum(b1, at + size + reach)


def _enough_known(got: Passages, items: Items, q: np.ndarray, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether words ``a`` to ``b`` have enough words whose slot item ``q`` has, for a common subsequence of ``share``."""
    keep = np.zeros(len(q), bool)
    for part in range(0, len(q), 1 << 14):
        cut = slice(part, part + (1 << 14))
        n = b[cut] - a[cut]
        ends = np.cumsum(n)
        words = np.repeat(a[cut] - ends + n, n) + np.arange(ends[-1])
        known = items.has[np.repeat(q[cut], n), got.slots[words]]
        keep[cut] = np.add.reduceat(known, ends - n, dtype=np.int64) >= share * items.sizes[q[cut]]
    return keep


def exact_candidates(got: Passages, items: Items, space: np.ndarray, share: float) -> dict[tuple[int, int], list[tuple[float, int, int]]]:
    """Like ``candidates``, of the places that have a gram of an item; the cosine is that of so many words as the item has."""
    found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for size, (hashes, owner, place, known) in items.grams.items():
        first, here = got.grams(size)
        likely = np.flatnonzero(known[(here >> U(64 - GRAM_BITS)).astype(np.int64)])
        lo, hi = (np.searchsorted(hashes, here[likely], side=side) for side in ("left", "right"))
        n = hi - lo
        row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, at = owner[row], np.repeat(first[likely], n)
        if not len(q):
            continue
        doc = np.searchsorted(got.bounds, at, side="right") - 1
        b0, b1 = got.bounds[doc], got.bounds[doc + 1]
        start = np.maximum(b0, at - place[row])
        # the grams of one copy give one place
        _, one = np.unique(np.column_stack([q, start]), axis=0, return_index=True)
        q, start, doc, b0, b1 = q[one], start[one], doc[one], b0[one], b1[one]
        keep = _enough_known(got, items, q, *_region(start, items.sizes[q], items.sizes[q], b0, b1), share)
        for doc, q, at, end in zip(doc[keep].tolist(), q[keep].tolist(), start[keep].tolist(), b1[keep].tolist(), strict=True):
            m = int(items.sizes[q])
            near = found.setdefault((doc, q), [])
            # a whole copy cannot be bettered
            if near and near[-1][0] == 2.0:
                continue
            if got.hashes[at : min(at + m, end)].tolist() == items.words[q]:
                near[:] = [(2.0, at, m)]
            else:
                z = _unit(space[got.slots[at : min(at + m, end)]].sum(axis=0, keepdims=True))[0]
                near.append((float(z @ items.latent[q]), at, m))
    for (_, q), near in found.items():
        if near[-1][0] == 2.0:
            z = items.latent[q]
            near[-1] = (float(z @ z), *near[-1][1:])
    return found


def candidates(got: Passages, items: Items, space: np.ndarray, cosine: float, share: float) -> dict[tuple[int, int], list[tuple[float, int, int]]]:
    """(document, item) -> (cosine, first word, words) of the passages near the item, the nearest first.

    A common subsequence cannot be longer than the number of words around the passage whose slot
    the item has; passages that fall short of ``share`` by this bound are left out.
    """
    found = exact_candidates(got, items, space, share)
    for size, z in got.whole(got.sums(space)):
        if size not in items.by_size:
            continue
        vectors, owner = items.by_size[size]
        first, z = got.starts(size), _unit(z)
        for lo in range(0, len(z), 1 << 13):
            near = z[lo : lo + (1 << 13)] @ vectors.T
            row, col = np.divmod(np.flatnonzero(near >= cosine), len(owner))
            at, q, c = first[lo + row], owner[col], near[row, col]
            doc, start = got.step_doc[at], got.step_start[at]
            a, b = _region(start, size * STEP, items.sizes[q], got.bounds[doc], got.bounds[doc + 1])
            keep = _enough_known(got, items, q, a, b, share)
            for doc, q, c, start in zip(doc[keep].tolist(), q[keep].tolist(), c[keep].tolist(), start[keep].tolist(), strict=True):
                found.setdefault((doc, q), []).append((c, start, size * STEP))
    for near_ in found.values():
        near_.sort(reverse=True)
    return found


def verify(got: Passages, items: Items, doc: int, item: int, near: list[tuple[float, int, int]], share: float, answer: float) -> tuple | None:
    """(cosine, covered share, answer share) of the best passage that passes both checks."""
    words = items.words[item]
    tail = words[-max(3, len(words) // 5) :]
    b0, b1 = got.bounds[doc], got.bounds[doc + 1]
    best = None
    for cosine, at, size in near:
        lo, hi = _region(at, size, len(words), b0, b1)
        region = got.hashes[lo:hi].tolist()
        covered = common_subsequence(words, region) / len(words)
        if covered < share or (best and covered <= best[1]):
            continue
        last = common_subsequence(tail, region) / len(tail)
        if last >= answer:
            best = (cosine, covered, last)
        if covered == 1:
            break
    return best


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    cosine: float = COSINE, share: float = LCS_SHARE, answer: float = ANSWER_SHARE, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, cosine, lcs_share, answer_share."""
    spark = docs.sparkSession
    kind = T.StructType([docs.schema[id_col], T.StructField("item_id", T.LongType()), *T._parse_datatype_string("cosine double, lcs_share double, answer_share double").fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    listed = benchmark.filter(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-listed.count() // BLOCK_ITEMS)))))
    blocks = sorted(r[0] for r in listed.select("block").distinct().collect())
    if not blocks:
        return spark.createDataFrame([], kind)
    idf = idf_weights(rows)
    space = latent_space(rows, idf)
    out = None
    for block in blocks:
        held = listed.filter(F.col("block") == block).orderBy("item", "text").collect()  # about BLOCK_ITEMS rows
        shared = spark.sparkContext.broadcast((space, Items([r["item"] for r in held], [r["text"] for r in held], space, least_words)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                for lo, hi, data, offsets in text_chunks(batch.column(1)):
                    got = Passages(data, offsets)
                    hits = []
                    for (doc, item), near in candidates(got, items, space, cosine, share).items():
                        best = verify(got, items, doc, item, near, share, answer)
                        if best:
                            hits.append((lo + doc, items.ids[item], *best))
                    columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], kind.fieldNames())

        part = rows.mapInArrow(search, kind)
        out = part if out is None else out.union(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows in whose text no benchmark item is found, with all their columns; ids play no part."""
    key = fresh("text", docs)
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    leaking = written(find_leaks(marked, benchmark, key, text_col, least_words=least_words).select(F.col(key).alias(f"{key}_k")).distinct(), "leaking")
    return marked.join(leaking, F.col(key) == F.col(f"{key}_k"), "left_anti").drop(key)

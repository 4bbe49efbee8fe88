"""Two tokenizers' tokens of the same text, aligned where both end.

A is a byte-level BPE file of the ``tokenizers`` library, B a sentencepiece model that puts a space
before the text; both see the same bytes, space and text. An interval between two common ends is
divided at a common end near the middle of its A tokens, found by leaping between the two lists
of ends with bisections, to the right first, then to the left; both halves are divided again.
An interval without a common end inside is a group. All intervals of a slice of documents
are divided at once, so there is one step per level and not one per group.

Two tokens that end together are linked. The shorter one is then a suffix of the longer one, so
the vocabularies alone say which pairs can be linked (``possible_links``): a few hundred thousand at
most, whatever the corpus. Counts over the corpus are made by Spark for these pairs and are bounded
by them, so they may be sent to every task.

Defined cases: a text that is null or empty, or whose A or B bytes are not space and text (B changes
or lacks something), has no tokens and no links; a null id is passed through; rows that repeat count
as often as they come; an empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tables import stored
from massif.llm.text import text_chunks
from massif.llm.tokenization import SLICE_BYTES as ENCODED_BYTES
from massif.llm.tokenization import byte_letters, encoder

#: Bytes of text that are aligned at once; A's tokens are found for ENCODED_BYTES at a time.
SLICE_BYTES = 1 << 18
#: Links that are added up at once.
SLICE_LINKS = 1 << 18
ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, links array<int>, n_a bigint, n_b bigint, groups_sha256 string"


class TokenBytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        place = np.repeat(self.firsts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.bytes[place].tobytes()


def byte_level_tokens(path: str) -> TokenBytes:
    vocab = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    back = {ord(letter): b for b, letter in enumerate(byte_letters())}
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = token.translate(back).encode("latin-1")
    return TokenBytes(tokens)


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> TokenBytes:
    def value(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return TokenBytes([value(i) for i in range(model.vocab_size())])


def possible_links(a: TokenBytes, b: TokenBytes) -> np.ndarray:
    """All pairs of tokens of which one is a suffix of the other, as sorted ``a * len(b) + b``."""
    keys: set[int] = set()
    n = len(b.tokens)
    for longer, shorter, key in ((a, b, lambda i, j: i * n + j), (b, a, lambda i, j: j * n + i)):
        known: dict[bytes, list[int]] = {}
        for j, token in enumerate(shorter.tokens):
            known.setdefault(token, []).append(j)
        for i, token in enumerate(longer.tokens):
            for start in range(len(token)):
                keys.update(key(i, j) for j in known.get(token[start:], ()))
    return np.array(sorted(keys), np.int64)


def common_ends(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all common ends, ascending.

    ``a`` and ``b`` ascend strictly. Interval i, of ``a[a_bounds[i]:a_bounds[i + 1]]`` and the same of ``b``, ends in both at its last value.
    """
    lo_a, hi_a, lo_b, hi_b = a_bounds[:-1], a_bounds[1:], b_bounds[:-1], b_bounds[1:]
    full = hi_a > lo_a
    found_a, found_b = [hi_a[full] - 1], [hi_b[full] - 1]
    while True:
        # what may still have a common end before its last one
        open_ = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[open_], hi_a[open_], lo_b[open_], hi_b[open_]
        if not len(lo_a):
            return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))
        middle = (lo_a + hi_a - 1) // 2
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        # to the right: the next end of b at or after this one of a, and so on in turn
        rows, i = np.arange(len(lo_a)), middle
        while len(rows):
            inside = i < hi_a[rows] - 1
            rows, i = rows[inside], i[inside]
            j = np.searchsorted(b, a[i])
            inside = j < hi_b[rows] - 1
            rows, i, j = rows[inside], i[inside], j[inside]
            met = a[i] == b[j]
            cut_a[rows[met]], cut_b[rows[met]] = i[met], j[met]
            rows = rows[~met]
            i = np.searchsorted(a, b[j[~met]])
        to_right = cut_a >= 0
        rows = np.flatnonzero(~to_right)
        i = middle[rows] - 1
        while len(rows):
            inside = i >= lo_a[rows]
            rows, i = rows[inside], i[inside]
            j = np.searchsorted(b, a[i], side="right") - 1
            inside = j >= lo_b[rows]
            rows, i, j = rows[inside], i[inside], j[inside]
            met = a[i] == b[j]
            cut_a[rows[met]], cut_b[rows[met]] = i[met], j[met]
            rows = rows[~met]
            i = np.searchsorted(a, b[j[~met]], side="right") - 1
        cut = cut_a >= 0
        found_a.append(cut_a[cut])
        found_b.append(cut_b[cut])
        # nothing lies between a cut on the left and the end: its second half is a group
        second = to_right
        lo_a, hi_a, lo_b, hi_b = (
            np.concatenate([lo_a[cut], cut_a[second] + 1]),
            np.concatenate([cut_a[cut] + 1, hi_a[second]]),
            np.concatenate([lo_b[cut], cut_b[second] + 1]),
            np.concatenate([cut_b[cut] + 1, hi_b[second]]),
        )


class Aligner:
    """The worker's pair of vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        self.a_path = a_path
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = byte_level_tokens(a_path), piece_tokens(self.model)
        self.pairs = possible_links(self.a, self.b)
        # an id as written within its group and at the end of its side, A's then B's
        self.shown = [f"{i}{mark}" for tokens, last in ((self.a.tokens, "|"), (self.b.tokens, ";")) for i in range(len(tokens)) for mark in (",", last)]

    def groups_text(self, a_ids: np.ndarray, b_ids: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, ends: np.ndarray) -> Iterator[str]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``; empty without tokens. ``ends`` bounds the tokens of both sides together."""
        a_codes, b_codes = 2 * a_ids, 2 * (b_ids + len(self.a.tokens))
        a_codes[cut_a] += 1
        b_codes[cut_b] += 1
        # every group's A tokens stand before its B tokens
        out = np.empty(len(a_codes) + len(b_codes), np.int64)
        out[np.arange(len(a_codes)) + np.repeat(np.concatenate([[0], cut_b[:-1] + 1])[: len(cut_a)], np.diff(cut_a, prepend=-1))] = a_codes
        out[np.arange(len(b_codes)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))] = b_codes
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            yield "".join(map(self.shown.__getitem__, out[lo:hi].tolist()))[:-1]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        """Row ranges and their columns. A's tokens are found for larger slices, in which more words repeat."""
        for lo, hi, _, _ in text_chunks(texts, ENCODED_BYTES):
            part = texts.slice(lo, hi - lo)
            held = [t or "" for t in part.to_pylist()]
            a_lists = encoder(self.a_path).encode([" " + t if t else "" for t in held])
            for a, b, _, _ in text_chunks(part, SLICE_BYTES):
                yield lo + a, lo + b, self.align(held[a:b], a_lists[a:b])

    def align(self, texts: list[str], a_lists: list[np.ndarray]) -> list[pa.Array]:
        """The columns of ``ALIGNED`` of texts whose A tokens are known."""
        spaced = [" " + t if t else "" for t in texts]
        b_lists = [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]
        for k, text in enumerate(spaced):
            raw = text.encode()
            if not text or self.a.joined(a_lists[k]) != raw or self.b.joined(b_lists[k]) != raw:
                a_lists[k] = b_lists[k] = np.zeros(0, np.int64)
        a_ids, b_ids = (np.concatenate(x).astype(np.int64) for x in (a_lists, b_lists))
        a_bounds, b_bounds = (np.cumsum([0, *map(len, x)]) for x in (a_lists, b_lists))
        cut_a, cut_b = common_ends(np.cumsum(self.a.sizes[a_ids]), np.cumsum(self.b.sizes[b_ids]), a_bounds, b_bounds)
        links = np.searchsorted(self.pairs, a_ids[cut_a] * len(self.b.tokens) + b_ids[cut_b])
        groups = np.searchsorted(cut_a, a_bounds)
        sizes = [np.diff(np.concatenate([[-1], cut])) for cut in (cut_a, cut_b)]
        columns = [(a_bounds, a_ids), (b_bounds, b_ids), (groups, sizes[0]), (groups, sizes[1]), (groups, links)]
        shown = self.groups_text(a_ids, b_ids, cut_a, cut_b, a_bounds + b_bounds)
        digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in shown], pa.string())
        lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32))) for bounds, values in columns)
        return [*lists, pa.array(np.diff(a_bounds)), pa.array(np.diff(b_bounds)), digests]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, stored.

    ``a_ids`` and ``b_ids`` are the tokens, ``a_sizes`` and ``b_sizes`` how many of them each group
    has (``n_a`` and ``n_b`` in all), and ``links`` the place in ``possible_links`` of the pair that ends each group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for lo, hi, columns in both.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["id", *(c.split()[0] for c in ALIGNED.split(", "))])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(ALIGNED).fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, schema), "aligned").withColumnRenamed("id", id_col)


def link_counts(spark: SparkSession, aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How often each pair is linked in the whole table: link, a_id, b_id, n, is_best (no pair with the same B id has more)."""
    both = aligner(a_path, b_path)
    counted = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")).toArrow()  # at most len(pairs) rows
    link, n = counted.column("link").to_numpy().astype(np.int64), counted.column("n").to_numpy().astype(np.int64)
    a_id, b_id = np.divmod(both.pairs[link], len(both.b.tokens))
    most = np.zeros(len(both.b.tokens), np.int64)
    np.maximum.at(most, b_id, n)
    table = pa.table({"link": pa.array(link.astype(np.int32)), "a_id": pa.array(a_id.astype(np.int32)), "b_id": pa.array(b_id.astype(np.int32)), "n": n, "is_best": n == most[b_id]})
    return spark.createDataFrame(table, "link int, a_id int, b_id int, n bigint, is_best boolean")


SCORED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def score_links(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: its tokens, groups and links, how many links are the best of their B id, the sum of all links' counts, and the digest of its groups."""
    held = counts.select("link", "n", "is_best").toArrow()  # bounded by the vocabularies
    size = int(np.max(held.column("link").to_numpy(), initial=-1)) + 1
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[held.column("link").to_numpy()] = held.column("n").to_numpy()
    best[held.column("link").to_numpy()] = held.column("is_best").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            lo = 0
            while lo < batch.num_rows:  # some documents at a time: the sums run over all their links
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_LINKS, side="right")) - 1)
                links = values[offsets[lo] : offsets[hi]]
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[offsets[lo : hi + 1] - offsets[lo]]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, sums)], ["row", "n_best", "count_sum"])
                lo = hi

    row = F.struct(F.col(id_col).alias("id"), "n_a", "n_b", F.size("links").cast("bigint").alias("n_groups"), "groups_sha256")
    rows = aligned.select(row.alias("row"), "links")
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_best bigint, count_sum bigint").fields])
    scored = rows.mapInArrow(run, schema).select("row.*", "n_best", "count_sum").withColumn("n_links", F.col("n_groups"))
    return scored.select("id", *(c.split()[0] for c in SCORED.split(", "))).withColumnRenamed("id", id_col)

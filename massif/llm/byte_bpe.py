"""Byte-level BPE by a rank file: texts to ids and back, through a sentencepiece model.

The model is serialised straight from the vocabulary. Every token's bytes become letters, one
letter a byte, so that any byte string is a valid piece; a piece's score is its negative rank and
its id its rank; nothing is normalised. The model then merges the neighbours of least rank first,
the leftmost of equal ones, which is what the ranks mean. A text is cut by the vocabulary's
pattern; each pre-token that is a token itself has that id, any other is merged by the model, in
time n log n of its length. Decoding maps the letters of the pieces back.

Defined cases: a null or empty text has no ids and decodes to empty bytes; a null list of ids is an
empty one; ids that the vocabulary lacks, and null ids in a list, decode to nothing; a null id of a row is passed
through; rows that repeat come out as often; an empty table gives no rows. Other columns are passed
over.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.tokenization import byte_letters, text_slices

#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL = 1, 2, 3
#: Fixed value: the number of the BPE model type.
BPE = 2
#: A worker keeps the ids of this many pre-tokens of up to this many characters.
CACHE_UNITS, LONG_UNIT = 200_000, 64
SLICE_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary needs a token for every byte")
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary; the id after the last rank is the unknown piece."""
    letters = byte_letters()
    size = max(ranks.values()) + 1
    pieces = [(f"<free {i}>", CONTROL) for i in range(size)]
    for token, rank in ranks.items():
        pieces[rank] = ("".join(letters[b] for b in token), NORMAL)
    pieces.append(("<unknown>", UNKNOWN))
    out = bytearray()
    for rank, (piece, kind) in enumerate(pieces):
        # piece = 1, score = 2 (32-bit float, exact up to 2**24), type = 3
        out += _message(1, _message(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, kind))
    # trainer_spec = 2: model_type = 3, vocab_size = 4
    out += _message(2, _number(3, BPE) + _number(4, len(pieces)))
    # normalizer_spec = 3: name = 1, add_dummy_prefix = 3, remove_extra_whitespaces = 4, escape_whitespaces = 5
    out += _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cut = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {self.model.id_to_piece(i): i for i in ranks.values()}
        back = {ord(letter): b for b, letter in self.letters.items()}
        known = [b""] * self.model.vocab_size()
        for piece, rank in self.whole.items():
            known[rank] = piece.translate(back).encode("latin-1")
        # the last entry stands for all ids that are not in the vocabulary
        known[-1] = b""
        self.sizes = np.array([len(k) for k in known], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(known), np.uint8)
        self.units: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        mapped = [u.encode().decode("latin-1").translate(self.letters) for u in units]
        merged = [(u, m) for u, m in zip(units, mapped, strict=True) if m not in self.whole]
        for u, m in zip(units, mapped, strict=True):
            if m in self.whole:
                self.units[u] = array("I", [self.whole[m]]).tobytes()
        for (u, _), ids in zip(merged, self.model.encode([m for _, m in merged], num_threads=1), strict=True):
            self.units[u] = array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        cut = [self.cut(t) for t in texts]
        seen = set().union(*cut)
        missing = seen.difference(self.units)
        if len(self.units) + len(missing) > CACHE_UNITS:
            self.units.clear()
            missing = seen
        self._learn(list(missing))
        find = self.units.__getitem__
        out = [np.frombuffer(b"".join(map(find, units)), np.uint32) for units in cut]
        for unit in [u for u in missing if len(u) > LONG_UNIT]:
            del self.units[unit]
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and where each list, ending at ``ends``, ends in them."""
        last = len(self.sizes) - 1
        known = np.where((ids >= 0) & (ids < last), ids, last)
        sizes = self.sizes[known]
        after = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(after[-1]) + np.repeat(self.firsts[known] - after[:-1], sizes)
        return self.bytes[place], after[ends]


_MODELS: dict[tuple[str, str], ByteBpe] = {}


def model(path: str, pattern: str) -> ByteBpe:
    """The worker's model of a rank file."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = ByteBpe(path, pattern)
    return _MODELS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ids: the ids of each row's text, by the rank file at ``ranks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for lo, hi in text_slices(texts, SLICE_CHARS):
                lists = bpe.encode(texts[lo:hi])
                ends = np.cumsum([0, *map(len, lists)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("ids array<int>").fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids in a column decoded (which replaces one of that name)."""
    kept = encoded.drop("decoded")
    # where null ids or lists stand, an id outside the vocabulary
    plain = F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: F.coalesce(i.cast("int"), F.lit(-1)))
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), plain.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks, pattern)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()
            lo = 0
            while lo < len(lists):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_CHARS, side="right")) - 1)
                raw, ends = bpe.decode(ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), out], ["row", "decoded"])
                lo = hi

    schema = T.StructType([T.StructField("row", T.StructType(kept.schema.fields)), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, schema).select("row.*", "decoded")

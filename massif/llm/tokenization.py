"""Token ids by the ``tokenizers`` library, with repeated pre-tokens encoded once per worker.

A byte-pair model encodes each pre-token by itself, and no pre-token of the two supported kinds
reaches across certain blanks: byte-level models begin a new one at a space, word models drop
white space. So a text of ordinary characters is cut there; each distinct unit is cut further by
the tokenizer's own pre-token pattern, spelled out for those characters, and encoded once by the
library's model. Arrow cuts the texts and numbers a slice's distinct units, so Python sees each unit
once per slice, not once per occurrence, and the ids are put together by their numbers. Any other text, and
any other kind of tokenizer, goes through the whole library. Both ways give the same ids.

The vocabulary's added tokens ('<|endoftext|>') are matched inside texts where the caller asks for
the library's own default (``added``), as the queries do: texts that hold one go through the whole
library. Without it such a string is ordinary text (``encode_special_tokens``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from massif.llm.text import text_chunks

#: Letters and numbers below U+0250, and the published pre-token patterns over them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|{SHORT}| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORDS = re.compile(rf"[{LETTER}]+|[{NUMBER}]|{SHORT}|[^\s{LETTER}{NUMBER}]+")
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that the spelled-out patterns do not cover, or whose lower case is not one character.
UNSURE = re.compile("[^\t\n\r -~\xa1-įı-ɏ]")
#: Runs of white space that a cut before each space would divide.
DIVIDED_RUN = re.compile(r"\s (?:\s|\Z)")
#: A worker keeps the ids of so many units and pieces, of up to LONG_UNIT bytes each (below 250 MB, typically 40).
CACHE_UNITS, CACHE_PIECES = 600_000, 150_000
LONG_UNIT = 64
#: Bytes of text that are encoded at once: a call looks through all that is kept, so small slices would pay for that again and again.
SLICE_BYTES = 1 << 22
TOKEN_ID = attrgetter("id")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _binaries(ends: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.LargeBinaryArray:
    """The slices of ``data`` between ``ends``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])


def _joined(values: pa.LargeBinaryArray, codes: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The values that ``codes`` number, those between two bounds as one."""
    parts = values.take(pa.array(codes))
    ends = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    return _binaries(ends[bounds], parts.buffers()[2] or b"")


class Known:
    """The ids of the strings used last, as Arrow arrays."""

    def __init__(self, limit: int, make: Callable[[list[str]], pa.LargeBinaryArray]):
        self.limit, self.make = limit, make
        self.names, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.now = np.zeros(0, np.int64), 0

    def find(self, names: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct strings."""
        at = pc.index_in(names, value_set=self.names)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        missing = place < 0
        self.now += 1
        self.used[place[~missing]] = self.now
        place[missing] = len(self.names) + np.arange(missing.sum())
        new = names.filter(at.is_null())
        self.names = pa.concat_arrays([self.names, new])
        self.ids = pa.concat_arrays([self.ids, self.make(new.to_pylist())])
        self.used = np.append(self.used, np.full(len(new), self.now))
        found = self.ids.take(pa.array(place))
        short = pc.binary_length(self.names).to_numpy() <= LONG_UNIT
        if len(self.names) > self.limit or not short.all():
            kept = np.flatnonzero(short)
            if len(kept) > self.limit:  # room for half as many again, so that not every call drops some
                kept = kept[np.argpartition(-self.used[kept], self.limit // 2)[: self.limit // 2]]
            self.names, self.ids, self.used = self.names.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.used[kept]
        return found


class Encoder:
    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        # tokens that are not special are matched in either case
        self.added = [x["content"].lower() for x in described.get("added_tokens") or [] if added or not x["special"]]
        pre, norm = described.get("pre_tokenizer") or {}, described.get("normalizer")
        parts = pre.get("pretokenizers") or [{}]
        self.cut, self.fold = None, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.cut = BYTE_LEVEL.findall
        elif (
            [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORDS_PATTERN}
            and (parts[0]["invert"], parts[0]["behavior"], parts[1]["use_regex"], parts[1]["add_prefix_space"]) == (True, "Removed", False, False)
        ):
            self.cut, self.fold = WORDS.findall, True
        self.letters = dict(enumerate(byte_letters()))
        self.units = Known(CACHE_UNITS, lambda units: self._cut_units(units, "" if self.fold else " "))
        self.pieces = Known(CACHE_PIECES, self._tokens)

    def _holds_added(self, text: str) -> bool:
        if not self.added:
            return False
        low = text.lower()
        return any(token in low for token in self.added)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _tokens(self, pieces: list[str]) -> pa.LargeBinaryArray:
        """Ids of pre-tokens."""
        ids, ends, blank = [], [0], self.letters[32]
        for piece in pieces:
            word = piece[1:] if piece[0] == " " else piece
            name = word if word.isalnum() and word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids.extend(map(TOKEN_ID, self.model.tokenize(name if word is piece else blank + name)))
            ends.append(len(ids))
        return _binaries(4 * np.array(ends, np.int64), np.array(ids, np.uint32))

    def _cut_units(self, units: list[str], before: str = "") -> pa.LargeBinaryArray:
        """Ids of units, with ``before`` in front of each, whose pre-tokens are known to be those of the spelled-out pattern."""
        pieces, ends = [], [0]
        for unit in units:
            if self.fold:
                unit = unit.lower()
            if unit.isalpha():  # one pre-token
                pieces.append(before + unit)
            else:
                pieces += self.cut(before + unit)
            ends.append(len(pieces))
        numbered = pa.array(pieces, pa.large_string()).dictionary_encode()
        return _joined(self.pieces.find(numbered.dictionary), numbered.indices.to_numpy(), np.array(ends, np.int64))

    def _cut_texts(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of texts of ordinary characters."""
        held = pa.array(texts, pa.large_string())
        cut = pc.ascii_split_whitespace(held) if self.fold else pc.split_pattern(held, " ")
        numbered = cut.values.dictionary_encode()
        ids, codes, bounds = self.units.find(numbered.dictionary), numbered.indices.to_numpy(), cut.offsets.to_numpy()
        if not self.fold:  # the first unit of a text has no space before it
            firsts, codes = bounds[:-1], codes.copy()
            begun = self._cut_units(numbered.dictionary.take(pa.array(codes[firsts])).to_pylist())
            codes[firsts] = len(ids) + np.arange(len(texts))
            ids = pa.concat_arrays([ids, begun])
        whole = _joined(ids, codes, bounds)
        return [np.frombuffer(x.as_buffer(), np.uint32) if len(x.as_buffer()) else np.zeros(0, np.uint32) for x in whole]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        sure = [not (self.cut is None or UNSURE.search(t) or (not self.fold and DIVIDED_RUN.search(t)) or self._holds_added(t)) for t in texts]
        cut = iter(self._cut_texts([t for t, is_sure in zip(texts, sure, strict=True) if is_sure]) if any(sure) else ())
        return [next(cut) if is_sure else self._whole(t) for t, is_sure in zip(texts, sure, strict=True)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


def text_slices(texts: list[str], limit: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_column(path: str, texts: pa.Array, added: bool = False) -> Iterator[np.ndarray]:
    """Ids of each text in order; null is empty."""
    enc = encoder(path, added)
    for lo, hi, _, _ in text_chunks(texts, SLICE_BYTES):
        yield from enc.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])

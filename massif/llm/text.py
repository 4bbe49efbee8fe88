"""Vectorised words, rolling hashes and winnowing over the texts of an Arrow batch.

Texts are handled as their UTF-8 bytes, whole. A batch is cut into chunks of whole
documents of about ``CHUNK_BYTES`` so that the working arrays stay small; a longer
document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[lo, hi)``, their bytes, and the offset of each row in them; null is an empty text."""
    texts = texts.fill_null("")
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    held = texts.buffers()[2] if n else None
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + chunk_bytes, side="right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    held = _POWERS.get(base)
    if held is None:
        held = np.ones(1, U)
    while len(held) < n:
        held = np.concatenate([held, held * U(pow(base, len(held), 1 << 64))])
    _POWERS[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_BYTES = {seed: byte_values(seed) for seed in (1, 2)}

#: Slices of up to so many bytes are hashed together, in steps of eight bytes.
STEPPED = 64


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of slices of bytes.

    Every eight bytes are mixed into the hash before the next, so no sum of terms can cancel, as
    it does in polynomials modulo 2**64 for strings made of a string and its complement in turn.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U) + U(seed * _BASE % (1 << 64)))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    for at in range(0, STEPPED, 8):
        rows = np.flatnonzero((sizes > at) & (sizes <= STEPPED))
        if not len(rows):
            break
        left = np.minimum(sizes[rows] - at, 8)
        value = eights[starts[rows] + at] << (U(8) * (U(8) - left.astype(U)))
        out[rows] = mix(out[rows] ^ value) * U(_BASE)
    for row in np.flatnonzero(sizes > STEPPED):
        out[row] = U(xxhash.xxh3_64_intdigest(data[starts[row] : ends[row]].tobytes(), seed))
    return out


class Rolling:
    """Prefix polynomial hashes of a sequence; any slice's hash in constant time.

    Two slices with the same values have the same hash wherever they stand.
    """

    def __init__(self, values: np.ndarray, seed: int = 1):
        self.base = (_BASE * (2 * seed + 1)) % (1 << 64) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(self.base, len(values)), out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw hashes of the slices; compare only slices of equal length, or mix the length in."""
        return (self.sums[end] - self.sums[start]) * powers(self.inverse, len(self.sums))[start]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every slice of ``size`` values, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[size:] - self.sums[:n]) * powers(self.inverse, n))


class Words:
    """The words of a chunk: byte ranges, first word of each document, hashes.

    Words are ``[^\\x20\\x09-\\x0D]+``, or runs of the bytes that ``letters`` allows; they end at ``cuts``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: np.ndarray | None = None, cuts: np.ndarray | None = None):
        n = len(data)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if letters is None else letters[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cuts is not None:
            edge[cuts] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return slice_hashes(self.data, self.starts, self.ends, seed)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by start (doubling spans)."""
    if len(values) < size:
        return values[:0]
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


#: Bits of a place in a chunk, below the leading bits of its gram's hash.
PLACE_BITS = U(31)


def anchors(grams: np.ndarray, size: int, window: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: every window of ``window`` values inside one document chooses one of its grams.

    ``grams`` are the hashes of all slices of ``size`` values. The choice (the least leading
    bits, the rightmost of equal ones) depends on the window's content alone, so equal
    windows choose the same gram at the same place in them. Returns per chosen place: the
    place, the first window start that chose it, and how many consecutive starts did.
    """
    span = window - size + 1
    if len(grams) < span:
        return (np.zeros(0, np.int64),) * 3
    last = (U(1) << PLACE_BITS) - U(1)
    packed = (grams & ~last) | (last - np.arange(len(grams), dtype=U))
    place = (last - (sliding_min(packed, span) & last)).astype(np.int64)
    valid = np.ones(len(place), bool)
    for end in bounds[1:]:
        valid[max(0, end - window + 1) : end] = False
    starts = np.flatnonzero(valid)
    chosen = place[starts]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else np.zeros(0, np.int64)
    return chosen[new], starts[new], np.diff(np.append(new, len(starts)))

"""Document quality from a linear-chain conditional random field over lines.

Every line has a state, good or bad. Its features are the binned shapes of the line and of
its neighbours: case, digits, symbols, word lengths, repetition, repeated lines. The field is
trained on the lines of labelled documents (a line has its document's label); the forward-
backward marginals, weighted by line length, are the document's quality and are calibrated to
the document label.

Learning is from a bounded sample (``SAMPLE_PER_LABEL`` documents of each label), scoring is of
every whole text; chains are cut after ``CHAIN`` lines. Defined cases: null and empty texts are one
empty line; without learning documents of both labels every score is the share of label 1 (one
half if none); rows that repeat score alike; a null id is passed through; an empty table gives
no rows. Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from massif.llm import labelled
from massif.llm.crf import ChainModel, Chains, fit_chains, fit_logistic, logistic, logit
from massif.llm.text import U, Words, mix, slice_hashes, text_chunks

CHAIN = 512
BINS = 10
#: Shapes of a line. Lengths and numbers of lines are none: they tell documents apart, not their quality.
SHAPES = 13
KEEP_FROM = 0.7


class Lines:
    """A chunk's lines: document, length, dense shapes and chains. Every document has at least one line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_docs, n = len(offsets) - 1, len(data)
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate([offsets[:-1], breaks[~np.isin(breaks, offsets[1:])]]))
        # empty documents share their start with the next one: one line for each document
        empty = np.flatnonzero(np.diff(offsets) == 0)
        first = np.concatenate([starts[np.isin(starts, offsets[:-1][np.diff(offsets) > 0]) | ~np.isin(starts, offsets)], offsets[:-1][empty]])
        doc = np.concatenate([np.searchsorted(offsets, first[: len(first) - len(empty)], side="right") - 1, empty])
        order = np.lexsort((first, doc))
        self.start, self.doc = first[order], doc[order]
        m = len(self.start)
        self.end = np.append(self.start[1:], n)
        last = np.append(self.doc[1:] != self.doc[:-1], True) if m else np.zeros(0, bool)
        self.end[last] = offsets[1:][self.doc[last]]
        size = self.end - self.start

        def total(flag: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return sums[self.end] - sums[self.start]

        upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
        digit, high = (data >= 48) & (data <= 57), data >= 128
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        symbol = ~(upper | lower | digit | high | blank)
        n_upper, n_lower, n_high = total(upper), total(lower), total(high)
        letters = np.maximum(n_upper + n_lower, 1)
        full = np.maximum(size, 1)
        words = Words(data, offsets, lower=True)
        hashed = words.hashes()
        at = np.searchsorted(words.starts, self.start), np.searchsorted(words.starts, self.end)
        n_words = at[1] - at[0]
        same = np.zeros(len(hashed) + 1, np.int64)
        same[1 : len(hashed)] = hashed[1:] == hashed[:-1]
        again = np.concatenate([[0], np.cumsum(same[: len(hashed)])])
        line_of = np.repeat(np.arange(m), n_words)
        pairs = np.unique(np.stack([line_of.astype(U), hashed]), axis=1) if len(hashed) else np.zeros((2, 0), U)
        distinct = np.bincount(pairs[0].astype(np.int64), minlength=m)
        line_hash = slice_hashes(data, self.start, self.end, 2)
        _, of, copies = np.unique(np.stack([self.doc.astype(U), line_hash]), axis=1, return_inverse=True, return_counts=True)
        stop = (data == 46) | (data == 63) | (data == 33)
        some = np.maximum(n_words, 1)
        self.shapes = np.column_stack([
            n_upper / letters, n_high / full, total(digit) / full, total(symbol) / full, total(data == 124) / full,
            total(data == 33) / full, total((data >= 35) & (data <= 38) | (data == 42)) / full, total(stop) / some, total(data == 44) / some, size / some,
            (again[at[1]] - again[at[0]]) / some, distinct / some, copies[of.ravel()] > 1,
        ]).astype(np.float64) if m else np.zeros((0, SHAPES))
        self.weight = full.astype(np.float64)
        new = np.ones(m, bool)
        new[1:] = self.doc[1:] != self.doc[:-1]
        heads = np.flatnonzero(new)
        within = np.arange(m) - np.repeat(heads, np.diff(np.append(heads, m)))
        new |= within % CHAIN == 0
        heads = np.flatnonzero(new)
        self.chains = Chains(heads, np.diff(np.append(heads, m)))

    def features(self, edges: np.ndarray) -> np.ndarray:
        """Indices of the binned shapes of the line, the one before and the one after in its document."""
        m, k = self.shapes.shape
        bins = np.stack([np.searchsorted(edges[j], self.shapes[:, j], side="right") for j in range(k)], axis=1)
        own = bins + np.arange(k) * BINS
        size = k * BINS
        before, after = np.full((m, k), 3 * size, np.int64), np.full((m, k), 3 * size + 1, np.int64)
        joined = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        before[joined + 1] = own[joined] + size
        after[joined] = own[joined + 1] + 2 * size
        return np.concatenate([own, before, after], axis=1)


@dataclass
class QualityModel:
    field: ChainModel | None
    edges: np.ndarray
    calibration: np.ndarray
    share: float

    def scores(self, lines: Lines, p: np.ndarray, n: int) -> np.ndarray:
        return logistic(self.calibration[0] + _aggregate(p, lines.doc, lines.weight, n) @ self.calibration[1:])


def _aggregate(p: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Per document: length-weighted mean of the marginals, and its log-odds."""
    mean = np.bincount(doc, p * weight, n) / np.maximum(np.bincount(doc, weight, n), 1e-9)
    return np.column_stack([mean * 4 - 2, logit(mean) / 5])


def fit_quality(texts: pa.Array, y: np.ndarray, share: float) -> QualityModel:
    """``share``: the share of label 1 among all learning rows, to which the sample is weighted back."""
    if not len(y) or y.min() == y.max():
        return QualityModel(None, np.zeros((SHAPES, BINS - 1)), np.zeros(3), share)
    chunks = [(lo, Lines(data, offsets)) for lo, _, data, offsets in text_chunks(texts)]
    shapes = np.concatenate([x.shapes for _, x in chunks])
    edges = np.quantile(shapes, np.arange(1, BINS) / BINS, axis=0).T
    features = np.concatenate([x.features(edges) for _, x in chunks])
    doc = np.concatenate([x.doc + lo for lo, x in chunks])
    weight = np.concatenate([x.weight for _, x in chunks])
    base = np.cumsum([0, *(len(x.doc) for _, x in chunks)])
    chains = Chains(np.concatenate([x.chains.start + b for (_, x), b in zip(chunks, base, strict=False)]), np.concatenate([x.chains.length for _, x in chunks]))
    field = fit_chains(features, chains, y[doc], 3 * SHAPES * BINS + 2, steps=80)
    x = _aggregate(field.marginals(features, chains), doc, weight, len(y))
    return QualityModel(field, edges, fit_logistic(x, y, share), share)


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = labelled.SAMPLE_PER_LABEL,
    key_col: str | None = None, beside: str | None = None,
) -> DataFrame:
    """One row per input row: id (or ``key_col``), score, lines, bad_lines (marginal below one half).

    With ``beside``: the whole row, and the other three as a struct of that name.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(*labelled.sample(docs, labels, label, learn, id_col, text_col, per_label)))

    def score(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        held, n = model.value, len(offsets) - 1
        lines = Lines(data, offsets)
        count = pa.array(np.bincount(lines.doc, minlength=n), pa.int64())
        if held.field is None:
            return [pa.array(np.full(n, held.share)), count, pa.array(np.zeros(n, np.int64))]
        p = held.field.marginals(lines.features(held.edges), lines.chains)
        return [pa.array(held.scores(lines, p, n)), count, pa.array(np.bincount(lines.doc, p < 0.5, n).astype(np.int64))]

    return labelled.score_documents(docs, score, "score double, lines bigint, bad_lines bigint", key_col or id_col, text_col, beside)

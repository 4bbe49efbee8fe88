"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given for documents. Words and word beginnings that occur in many toxic and
hardly any other learning documents mark tokens of toxic documents as toxic; the field is
trained on these labelled tokens, with the token, its beginnings and its neighbours as hashed
features. A chain is a line, cut after ``CHAIN`` tokens. The forward-backward marginals of a
document's tokens are aggregated (the largest, and the expected number among tagged tokens) and
calibrated to the document label; tokens above one half are offending spans.

Learning is from a bounded sample (``SAMPLE_PER_LABEL`` documents of each label); scoring is of
every whole text. Defined cases: null and empty texts have no tokens and score as such; without
learning documents of both labels every score is the share of label 1 (one half if none); rows
that repeat score alike; a null id is passed through; an empty table gives no rows. Other
columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from massif.llm import labelled
from massif.llm.crf import ChainModel, Chains, fit_chains, fit_logistic, logistic, logit
from massif.llm.text import _BYTES, Rolling, U, Words, mix, text_chunks

CHAIN = 128
#: So many that an unseen word hardly ever falls on a learnt feature.
FEATURE_BITS = 22
#: Lengths, in bytes, of the word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: A marking word's likelihood ratio (doubled logarithm; 1 word in 10,000 has it by chance) ...
LEXICON_PROOF = 15.0
#: ... and how many times likelier it is in toxic documents than in others.
LEXICON_RATIO = 50.0
#: Words of a run, and least hashes of runs by which copies are known.
RUN, LEAST_HASHES = 5, 2
#: Token letters: ASCII letters, digits, and all bytes of longer characters.
LETTERS = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Tokens:
    """A chunk's tokens, their features and chains."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True, letters=LETTERS)
        self.start, self.end, self.bounds = words.starts, words.ends, words.bounds
        n = len(self.start)
        rolling = Rolling(_BYTES[2][words.data], 5)
        size = self.end - self.start
        own = mix(rolling.slices(self.start, self.end) ^ size.astype(U))
        parts = [own]
        for k in BEGINNINGS:
            cut = np.minimum(size, k)
            head = mix(rolling.slices(self.start, self.start + cut) ^ U(1000 + k))
            parts.append(np.where(size >= k, head, U(k)))
        lines = np.cumsum(words.data == 10)
        new = np.zeros(n, bool)
        new[self.bounds[:-1][self.bounds[:-1] < n]] = True
        if n:
            new[1:] |= lines[self.start[1:]] != lines[self.start[:-1]]
        heads = np.flatnonzero(new)
        within = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        new |= within % CHAIN == 0
        heads = np.flatnonzero(new)
        self.chains = Chains(heads, np.diff(np.append(heads, n)))
        before, after = np.roll(own, 1), np.roll(own, -1)
        before[new] = U(1)
        last = np.append(heads[1:], n)[: len(heads)] - 1
        after[last] = U(2)
        parts += [mix(before ^ U(77)), mix(after ^ U(78))]
        self.words = parts[: 1 + len(BEGINNINGS)]
        self.context = parts[-2] ^ mix(parts[-1])
        self.features = np.stack([(x >> U(64 - FEATURE_BITS)).astype(np.int32) for x in parts], axis=1) if n else np.zeros((0, len(parts)), np.int32)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))


@dataclass
class ToxicityModel:
    field: ChainModel | None
    calibration: np.ndarray
    share: float

    def marginals(self, tokens: Tokens) -> np.ndarray:
        return self.field.marginals(tokens.features, tokens.chains)

    def scores(self, p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        if self.field is None:
            return np.full(n, self.share)
        x = _aggregate(p, doc, n)
        return logistic(self.calibration[0] + x @ self.calibration[1:])


def _aggregate(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document: log-odds of its most toxic token, and the logarithm of the expected number among tagged tokens.

    Neither grows with the mere length of a document.
    """
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    return np.column_stack([logit(most) / 5, np.log1p(np.bincount(doc, np.where(p >= 0.5, p, 0.0), n))])


def _families(own: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A family number for each of n documents: copies and near copies, which share one of their least hashes of a run of words, are one family."""
    run = own.copy()
    for k in range(1, RUN):
        run[: len(own) - k] = mix(run[: len(own) - k] ^ own[k:])
    whole = np.ones(len(own), bool)
    whole[max(len(own) - RUN + 1, 0) :] = False
    if len(own) >= RUN:
        whole[: len(own) - RUN + 1] = doc[: len(own) - RUN + 1] == doc[RUN - 1 :]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    known: dict[int, int] = {}
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for i in range(n):
        part = slice(bounds[i], bounds[i + 1])
        least = np.unique(mix(run[part][whole[part]]))[:LEAST_HASHES]
        for h in least.tolist():
            parent[root(i)] = root(known.setdefault(h, i))
    return np.array([root(i) for i in range(n)], np.int64)


def _likelihood_ratio(k: np.ndarray, other: np.ndarray, q: float) -> np.ndarray:
    """Log-likelihood ratio (doubled) of k among k + other against the share q."""
    total = k + other
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(x > 0, x * np.log(x / (total * share)), 0.0) for x, share in ((k, q), (other, 1 - q))]
    return 2 * (terms[0] + terms[1])


def _token_labels(parts: list[np.ndarray], context: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents whose word, or a beginning of it, marks toxic documents.

    Copied text is no further evidence: a word is counted once between the same neighbours, and
    once in a family of copies. Either count may prove it, by a likelihood ratio whose bound is
    the same for samples of every size.
    """
    toxic_docs, other_docs = int(y.sum()), int((1 - y).sum())
    toxic_token = y[doc] == 1
    marked = np.zeros(len(doc), bool)
    family = _families(parts[0], doc, len(y))[doc].astype(U)
    for part in parts:
        for unit in (context, family):
            counts = []
            for rows in (toxic_token, ~toxic_token):
                met = np.unique(np.stack([part[rows], unit[rows]]), axis=1)[0]
                counts.append(np.unique(met, return_counts=True))
            (keys, toxic), (known, n) = counts
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            other = np.where(known[at] == keys, n[at], 0) if len(known) else np.zeros(len(keys), np.int64)
            ratio = ((toxic + 0.1) / (toxic_docs + 1)) / ((other + 0.1) / (other_docs + 1))
            proven = _likelihood_ratio(toxic, other, toxic_docs / (toxic_docs + other_docs)) >= LEXICON_PROOF
            marked |= np.isin(part, keys[proven & (ratio >= LEXICON_RATIO)])
    return marked & toxic_token


def fit_toxicity(texts: pa.Array, y: np.ndarray, share: float) -> ToxicityModel:
    """``share``: the share of label 1 among all learning rows, to which the sample is weighted back."""
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, np.zeros(3), share)
    chunks = [(lo, Tokens(data, offsets)) for lo, _, data, offsets in text_chunks(texts)]
    doc = np.concatenate([t.doc + lo for lo, t in chunks])
    words = [np.concatenate([t.words[k] for _, t in chunks]) for k in range(1 + len(BEGINNINGS))]
    state = _token_labels(words, np.concatenate([t.context for _, t in chunks]), doc, y)
    features = np.concatenate([t.features for _, t in chunks])
    base = np.cumsum([0, *(len(t.doc) for _, t in chunks)])
    chains = Chains(np.concatenate([t.chains.start + b for (_, t), b in zip(chunks, base, strict=False)]), np.concatenate([t.chains.length for _, t in chunks]))
    field = fit_chains(features, chains, state, 1 << FEATURE_BITS, steps=30)
    x = _aggregate(field.marginals(features, chains), doc, len(y))
    return ToxicityModel(field, fit_logistic(x, y, share), share)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = labelled.SAMPLE_PER_LABEL
) -> DataFrame:
    """One row per input row: id, score, toxic_tokens (expected), spans (byte ranges of offending runs in the UTF-8 text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(*labelled.sample(docs, labels, label, learn, id_col, text_col, per_label)))

    def score(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        held = model.value
        n = len(offsets) - 1
        if held.field is None:
            empty = pa.array([[]] * n, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return [pa.array(held.scores(np.zeros(0), np.zeros(0, np.int64), n)), pa.array(np.zeros(n)), empty]
        tokens = Tokens(data, offsets)
        p = held.marginals(tokens)
        bad = np.flatnonzero(p >= 0.5)
        doc = tokens.doc[bad]
        new = np.ones(len(bad), bool)
        new[1:] = (np.diff(bad) > 1) | (np.diff(doc) > 0)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(bad)) - 1
        of = doc[heads] if len(heads) else np.zeros(0, np.int64)
        runs = pa.StructArray.from_arrays(
            [pa.array(tokens.start[bad[heads]] - offsets[of], pa.int64()), pa.array((tokens.end[bad[tails]] if len(heads) else np.zeros(0, np.int64)) - offsets[of], pa.int64())], ["start", "end"]
        )
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), runs)
        return [pa.array(held.scores(p, tokens.doc, n)), pa.array(np.bincount(tokens.doc, p, n)), spans]

    return labelled.score_documents(docs, score, "score double, toxic_tokens double, spans array<struct<start:bigint,end:bigint>>", id_col, text_col)

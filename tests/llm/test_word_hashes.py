"""Words, n-grams and windows that differ only by a sequence and its complement."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from massif.llm import ngram_join, substring_dedup
from massif.llm.text import Words, text_chunks
from tests.llm import brute

DOCS = "doc_id bigint, text string"
SWAP = str.maketrans("ab", "ba")


def alternating(size: int) -> str:
    """Doubled by its own complement until it has ``size`` letters."""
    text = "a"
    while len(text) < size:
        text += text.translate(SWAP)
    return text


def test_hashes_tell_all_words_apart():
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé字xyz") for _ in range(rnd.randint(1, 90))) for _ in range(3000)}
    for size in (2, 16, 64, 128, 256, 512, 1024):
        words |= {alternating(size), alternating(size).translate(SWAP), "a" * size}
    words = sorted(words)
    text = " ".join(words)
    seen = {}
    for texts in ([text, text], ["x " + text], ["\n" + text + " y"]):
        for lo, hi, data, offsets in text_chunks(pa.array(texts)):
            found = Words(data, offsets)
            for start, end, hashed in zip(found.starts, found.ends, found.hashes().tolist()):
                word = data[start:end].tobytes()
                assert seen.setdefault(word, hashed) == hashed
    assert len(set(seen.values())) == len(seen)
    assert {w.encode() for w in words} <= set(seen)
    assert np.array_equal(Words(data, offsets).hashes(2), Words(data, offsets).hashes(2))


def test_joins_and_windows_of_complements(spark):
    t = alternating(256)
    u = t.translate(SWAP)
    filler = " ".join(f"w{i}" for i in range(34))
    texts = [f"{filler} {t}", f"{filler} {u}", f"{t} q r {t} q r", f"{t} q r {u} q r", t, u, t]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = substring_dedup.remove_repeated_windows(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == [(i, *x) for i, x in enumerate(brute.substring(texts))]
    joined = ngram_join.near_duplicates(docs, words=3, num=90, den=100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in joined) == [(i, *x) for i, x in enumerate(brute.near_components(texts))]

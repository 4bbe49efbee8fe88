import random

import numpy as np
import pytest

from massif.llm import substring_dedup, suffix_dedup
from .brute import byte_strings, substring

SCHEMA = "doc_id bigint, text string, uid string, place int"


def corpus(seed: int, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(lexicon, k=k))
    shared = [prose(60), prose(36), prose(120)]
    texts: list[str | None] = [None, "", "  \n\t", "x", "To " * 200, prose(34), prose(3000) + "\n" + shared[0]]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            texts.append(prose(rng.randint(0, 90)))
        elif kind < 0.6:
            texts.append(prose(rng.randint(0, 30)) + " " + rng.choice(shared) + "\x0b " + prose(rng.randint(0, 30)))
        elif kind < 0.8:
            words = (rng.choice(texts) or prose(50)).split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append(rng.choice(texts))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r[0]: r[1:] for r in substring_dedup.remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert [tuple(got[i]) for i in range(len(texts))] == substring(texts)


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 14), (2, 2)])
def test_bytes_equal_brute_force(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = suffix_dedup.remove_repeated_bytes(docs, sort_rows=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = {r[0]: r[1:] for r in out.collect()}
    assert [tuple(got[i]) for i in range(len(texts))] == byte_strings(texts)


def test_kept_text_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, long, "", 0), (1, long, "", 0), (None, "a b", "", 0), (2, "head " + long, "", 0)], SCHEMA)
    rows = substring_dedup.remove_repeated_windows(docs, keep_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in rows) == [(0, 2, 0, None), (1, 40, 40, b""), (1, 40, 40, b""), (2, 41, 40, b"head")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeated_windows(docs).count() == 0
    assert suffix_dedup.remove_repeated_bytes(docs).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    begin = np.sort(rng.choice(300, 120, replace=False))
    end = begin + rng.integers(0, 100, 120)
    order = suffix_dedup.Suffixes(data, begin, end).sorted()
    raw = data.tobytes()
    assert [raw[begin[i] : end[i]] for i in order] == sorted(raw[a:b] for a, b in zip(begin, end, strict=True))

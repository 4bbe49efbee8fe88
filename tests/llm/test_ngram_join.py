import random

import numpy as np
import pytest

from massif.llm import ngram_join
from massif.llm.components import connected

from .brute import near_components

SCHEMA = "doc_id bigint, text string, node string, token int"


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abCdé", k=rng.randint(1, 6))) for _ in range(400)]
    base = [rng.choices(lexicon, k=rng.randint(20, 150)) for _ in range(12)]
    passage = rng.choices(lexicon, k=25)
    texts: list[str | None] = [None, "", " \n", "one", "ONE", "one two", "One  two", "a b c", "A B C"]
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(lexicon)
        if rng.random() < 0.2:
            words += passage
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("seed", "num", "den", "words", "most"), [(1, 90, 100, 3, 1500), (2, 8, 10, 5, 1500), (3, 90, 100, 3, 6)])
def test_components_equal_brute_force(spark, seed, num, den, words, most):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(docs, words, num, den, task_sets=most).select("doc_id", "n_shingles", "component_id").collect()}
    assert [got[i] for i in range(len(texts))] == near_components(texts, words, num, den)


def test_trie_finds_all_partners():
    rng = np.random.default_rng(3)
    sets = list({s.tobytes(): s for s in (np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(300))}.values())
    trie = ngram_join.Trie(sets)
    for r in range(len(sets)):
        want = {s for s in range(len(sets)) if s != r and len(sets[s]) <= len(sets[r]) and 10 * len(np.intersect1d(sets[r], sets[s])) >= 6 * len(np.union1d(sets[r], sets[s]))}
        assert set(trie.partners(r, 6, 10).tolist()) == want


def test_prefixes_rule_out_no_partner():
    rng = np.random.default_rng(4)
    sets = list({s.tobytes(): s for s in (np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(200))}.values())
    sets += [np.append(s, np.uint64(100)) for s in sets[:40]]
    sizes = np.array([len(s) for s in sets])
    heads = [s[: len(s) - -(-7 * len(s) // 10) + 1] for s in sets]
    whole, known = ngram_join.Trie(sets), ngram_join.Trie(heads, sizes)
    for r in range(len(sets)):
        assert set(whole.partners(r, 7, 10).tolist()) <= set(known.partners(r, 7, 10).tolist())
    group = np.arange(len(sets))
    linked = {x for r in range(len(sets)) for s in whole.partners(r, 7, 10).tolist() for x in (r, s)}
    kept = ngram_join.possible(heads, sizes, group, 7, 10)
    assert linked <= set(np.flatnonzero(kept).tolist()) and not kept.all()


def test_whole_sets_only_of_possible_partners(spark, monkeypatch):
    """Sets that share one rare n-gram and cannot be similar are told apart by their prefixes, in both rounds."""
    made = []
    join = ngram_join._join_tasks

    def noted(tasks, sets, *rest):
        made.append((tasks.count(), sets.count()))
        return join(tasks, sets, *rest)

    monkeypatch.setattr(ngram_join, "_join_tasks", noted)
    texts = ["x " + " ".join(f"d{i}w{k}" for k in range(10)) for i in range(40)]
    texts += [" ".join(f"e{k}" for k in range(60)), " ".join(f"e{k}" for k in range(61))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, words=1, num=90, den=100).collect()}
    assert got == {i: min(i, 40) for i in range(42)}
    assert sum(n for _, n in made) <= 2


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "u bigint, v bigint")
    got = {r.node: r.root for r in connected(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}


def test_empty_table_and_filter(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ngram_join.near_duplicates(docs).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(3, text, "x", 1), (1, text + " end", "x", 2), (2, "other words here", "x", 3), (4, None, "x", 4), (5, "", "x", 5)], SCHEMA)
    assert sorted(r.doc_id for r in ngram_join.drop_near_copies(docs).collect()) == [1, 2, 4, 5]

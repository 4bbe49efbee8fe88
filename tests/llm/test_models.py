import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from massif.llm import decontaminate, labelled, quality, toxicity
from massif.llm.crf import ChainModel, Chains, fit_chains
from massif.llm.queries import QUERIES
from massif.llm.tables import read_table

DOCS = "doc_id bigint, text string, score double, y int"
SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2])
    chains = Chains(np.array([0, 3, 4, 9]), lengths)
    features = rng.integers(0, 6, (11, 2))
    model = ChainModel(rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2))
    got = model.marginals(features, chains)
    emission = model.emissions(features)
    for start, length in zip(chains.start, lengths, strict=True):
        total, ones = 0.0, np.zeros(length)
        for states in itertools.product((0, 1), repeat=int(length)):
            score = model.initial[states[0]] + sum(emission[start + i] for i, s in enumerate(states) if s)
            score += sum(model.transition[a, b] for a, b in itertools.pairwise(states))
            total += np.exp(score)
            ones += np.exp(score) * np.array(states)
        assert np.allclose(got[start : start + length], ones / total)


def test_fit_learns_a_feature_and_a_transition():
    rng = np.random.default_rng(1)
    state = np.repeat(rng.integers(0, 2, 50), 20)
    noisy = np.where(rng.random(1000) < 0.8, state, 1 - state)
    chains = Chains(np.arange(0, 1000, 50), np.full(20, 50))
    model = fit_chains(noisy[:, None], chains, state, 2)
    assert ((model.marginals(noisy[:, None], chains) > 0.5) == state).mean() > 0.93


def test_held_out_accuracy(spark):
    """Held-out rows of the given tables: better than always answering the commoner label."""
    labels = read_table(spark, SF, "labels")
    for name, label, least in (("op6_toxicity", "toxic", 0.93), ("op10_quality_classifier", "quality", 0.93)):
        rows = QUERIES[name](spark, SF).join(labels, "doc_id").filter("held_out").select("predicted", F.col(label).alias("y")).collect()
        assert len(rows) > 50
        assert sum(r.predicted == r.y for r in rows) / len(rows) >= least


def test_scores_of_odd_documents(spark):
    rows = [(i, f"fine words{i} in a row{i} here{i * 7} " * 3 + ("you are an awful zzkrak person" if i % 2 else ""), 0.0, i % 2) for i in range(40)]
    odd = [(100, None, 0.0, None), (101, "", 0.0, None), (None, "zzkrak", 0.0, None), (103, "\n\n", 0.0, None), (104, "x" * 200_000, 0.0, None), (105, "é\n" * 3000, 0.0, None)]
    docs = spark.createDataFrame(rows + odd + rows[:2], DOCS)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None)], "doc_id bigint, label int")
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(docs, labels, F.lit(True), label="label").collect()
        assert len(got) == len(rows) + len(odd) + 2
        assert all(0 <= r.score <= 1 for r in got)
        none = score(docs, labels.filter("label = 1"), F.lit(True), label="label")
        assert {r.score for r in none.collect()} == {1.0}
        assert {r.score for r in score(docs, labels.limit(0), F.lit(True), label="label").collect()} == {0.5}
        assert score(docs.limit(0), labels, F.lit(True), label="label").count() == 0
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, F.lit(True), label="label").collect()}
    assert got[1].score > 0.5 > got[2].score
    assert any(b"zzkrak" in rows[1][1].encode()[s.start : s.end] for s in got[1].spans)


def test_lines():
    data = np.frombuffer(b"ab\ncd\n\nx" + b"tail" + b"\n\n", np.uint8)
    offsets = np.array([0, 0, 8, 8, 12, 14, 14])
    lines = quality.Lines(data, offsets)
    got = [(int(d), bytes(data[a:b])) for d, a, b in zip(lines.doc, lines.start, lines.end, strict=True)]
    assert got == [(0, b""), (1, b"ab\n"), (1, b"cd\n"), (1, b"\n"), (1, b"x"), (2, b""), (3, b"tail"), (4, b"\n"), (4, b"\n"), (5, b"")]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 0.0, 0) for i in range(100)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "doc_id bigint, label int")
    texts, y, share = labelled.sample(docs, labels, "label", labelled.fold("doc_id", 4) != 2, "doc_id", "text", per_label=7)
    assert len(texts) == 14 and y.sum() == 7 and 0.05 < share < 0.4


def plain_leaks(docs, items):
    """Brute force: longest common subsequences of every item with every document."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    return {(d, i) for d, text in docs for i, item in items if len(item.split()) >= 8 and common(item.split(), text.split()) >= 0.75 * len(item.split())}


def test_leaks_and_paraphrases(spark):
    rng = random.Random(7)
    lexicon = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(lexicon, k=k))) for i, k in enumerate([14, 20, 36, 59, 150, 5])]
    texts = [" ".join(rng.choices(lexicon, k=rng.randint(0, 200))) for _ in range(120)]
    for n, (_, item) in enumerate(items):
        words = item.split()
        texts[n] += " " + item.upper().replace(" ", ", ")
        for at in rng.sample(range(len(words)), len(words) // 6):
            words[at] = "other"
        texts[20 + n] = texts[20 + n] + " " + " ".join(words) + " " + texts[20 + n]
    docs = spark.createDataFrame([(i, t, 0.0, 0) for i, t in enumerate(texts)] + [(500, None, 0.0, 0), (501, "", 0.0, 0), (None, items[2][1], 0.0, 0)], DOCS)
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    low = [(d, t.lower().replace(",", "")) for d, t in enumerate(texts)]
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(low, items) | {(None, 2)}
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({r.doc_id for r in got})
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_common_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4, 2], [2, 9, 3, 2, 2, 4]) == 3
    assert decontaminate.common_subsequence([1], []) == 0

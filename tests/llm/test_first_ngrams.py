import random

import pytest

from massif.llm import ngram_join

from . import brute


def sets_of(spark, texts, monkeypatch, **settings):
    """The answer for the texts, and the rows of n-grams that were dealt on."""
    rows, keep = [], ngram_join.written

    def counted(df, label):
        out = keep(df, label)
        if label == "tokens":
            rows.extend(out.collect())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = ngram_join.near_duplicates(docs, **settings).select("doc_id", "component_id").collect()
    return dict(map(tuple, got)), rows


def test_ngrams_of_sets_of_other_sizes_are_not_dealt(spark, monkeypatch):
    # every text has the same word in its prefix, and no two sizes are within nine tenths of each other
    texts = ["shared " + " ".join(f"t{k}_{i}" for i in range(int(10 * 1.3**k))) for k in range(12)]
    got, rows = sets_of(spark, texts, monkeypatch, words=1, num=90, den=100)
    assert got == {k: k for k in range(12)} and not rows


@pytest.mark.parametrize(("task_sets", "num"), [(1500, 90), (3, 60)])
def test_no_link_is_lost(spark, monkeypatch, task_sets, num):
    random.seed(num)
    texts = []
    for _ in range(25):
        text = [f"v{random.randrange(60)}" for _ in range(random.choice([3, 4, 12, 30, 60]))]
        texts.append(" ".join(text))
        for _ in range(random.randrange(4)):
            text = list(text)
            for _ in range(random.randrange(1, 4)):
                text[random.randrange(len(text))] = f"v{random.randrange(60)}"
            texts.append(" ".join(text))
    got, _ = sets_of(spark, texts, monkeypatch, words=1, num=num, den=100, task_sets=task_sets)
    want = brute.near_components(texts, words=1, num=num, den=100)
    assert got == {k: component for k, (_, component) in enumerate(want)}

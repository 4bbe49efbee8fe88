import random

import pytest

from massif.llm import decontaminate
from massif.llm.queries import QUERIES

UNSPACED = {"Chinese": range(0x4E00, 0x4E00 + 400), "Japanese": range(0x3041, 0x3041 + 80), "Thai": range(0x0E01, 0x0E01 + 46)}


def holds(text: list[str], item: list[str]) -> bool:
    return any(text[i : i + len(item)] == item for i in range(len(text) - len(item) + 1))


def common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_short_items_are_found_word_for_word(spark):
    """Every copy that a brute force over all items, of one word too, finds; nothing below the common share."""
    rng = random.Random(12)
    lexicon = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(2000)]
    often = ["the", "of", "and", "to", "in"]
    items = [rng.choices(lexicon, k=1 + i % 15) for i in range(45)] + [rng.choices(often, k=9), [*rng.choices(often, k=6), lexicon[0], "of"]]
    texts = [[rng.choice(often) if rng.random() < 0.3 else rng.choice(lexicon) for _ in range(rng.randint(30, 150))] for _ in range(141)]
    for n, text in enumerate(texts):
        at = rng.randint(0, len(text))
        text[at:at] = items[n % len(items)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench, least_words=1).collect()}
    copies = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if holds(t, x)}
    assert len(copies) >= len(texts) and copies <= set(got)
    assert all(got[c].lcs_share == got[c].answer_share == 1 for c in copies)
    assert all(common(items[i], texts[d]) >= 0.6 * len(items[i]) for d, i in got)
    kept = {r.doc_id for r in decontaminate.drop_leaking(docs, bench, least_words=1).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}


@pytest.mark.parametrize("script", UNSPACED)
def test_items_of_unspaced_scripts(spark, script):
    rng = random.Random(5)
    letters = [chr(c) for c in UNSPACED[script]]
    items = ["".join(rng.choices(letters, k=k)) for k in (6, 9, 14, 30, 70)]
    texts = ["".join(rng.choices(letters, k=150)) for _ in range(40)]
    for n, item in enumerate(items):
        texts[n] = texts[n][: 50 + n] + item + texts[n][50 + n :]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontaminate.find_leaks(docs, bench, least_words=1).collect()}
    assert {(n, n) for n in range(len(items))} <= {k for k, share in got.items() if share == 1}
    assert all(common(list(items[i]), list(texts[d])) >= 0.6 * len(items[i]) for d, i in got)


def test_query_keeps_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "who wrote it ada lovelace " + "other words " * 30), (2, "nothing of that kind " * 9)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Who wrote it? Ada Lovelace.")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7)]


def test_items_of_frequent_words_are_found(spark):
    """Words of every other document keep their weight: an item of nothing else has a vector."""
    rng = random.Random(3)
    often = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(60)]
    rare = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(4000)]
    texts = [[rng.choice(often) if rng.random() < 0.5 else rng.choice(rare) for _ in range(120)] for _ in range(60)]
    items = [rng.choices(often, k=k) for k in (18, 30, 45)]
    for n, item in enumerate(items):
        texts[n][16:16] = item
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    assert decontaminate.idf_weights(docs).min() > 0
    assert {(n, n) for n in range(3)} <= {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}

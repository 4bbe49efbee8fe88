import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.llm import ngram_join


def random_sets(seed: int, sizes: list[int]) -> list[np.ndarray]:
    """Sets of these sizes, each with some copies that lack or have a few other elements."""
    rng = np.random.default_rng(seed)
    sets = []
    for size in sizes:
        whole = rng.integers(0, 1 << 56, size, dtype=np.uint64)
        sets.append(np.unique(whole))
        for share in (0.02, 0.06, 0.2, 0.5):
            other = whole.copy()
            other[rng.random(size) < share] ^= np.uint64(rng.integers(1, 1 << 56))
            sets.append(np.unique(other[: max(1, round(size * rng.uniform(1 - share, 1)))]))
    return sets


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10), (1, 5), (1, 1)])
def test_counts_rule_out_no_partner(num, den):
    # sizes on both sides of a change in the number of places, and one with more than 255 n-grams in some places
    sets = random_sets(num, [1, 2, 3, 9, 30, 63, 64, 66, 127, 129, 260, 500, 520, 1020, 1030])
    sets += [np.arange(3000, dtype=np.uint64) * np.uint64(1 << 20), np.arange(1, 3001, dtype=np.uint64) * np.uint64(1 << 20)]
    sizes = np.array([len(s) for s in sets])
    counts = [ngram_join._counted(s, len(s)) for s in sets]
    assert max(len(c) for c in counts) * 2 <= max(sizes) and len({len(c) for c in counts}) > 4
    group = np.random.default_rng(1).integers(0, len(sets) // 2, len(sets))
    linked = {
        x for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if group[i] != group[j] and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) for x in (i, j)
    }
    kept = set(np.flatnonzero(ngram_join.alike(counts, sizes, group, num, den)).tolist())
    assert linked <= kept and (linked or num == den)
    assert len(kept) < len(sets) or num < 0.5 * den
    assert not ngram_join.alike(counts, sizes, np.zeros(len(sets), int), num, den).any()


def test_sets_that_only_begin_alike_are_not_made_whole(spark, monkeypatch):
    """Pairs that share two thirds of their n-grams can be similar by their prefixes; few of them can be by their counts."""
    made, sent = [], []
    join, check = ngram_join._join_tasks, ngram_join._possible_tasks

    def joined(tasks, sets, *rest):
        made.append(sets.count())
        return join(tasks, sets, *rest)

    def checked(dealt, sets, *rest):
        size = F.length("counts") if "counts" in sets.columns else 8 * F.size("prefix")
        sent.append(sets.agg(F.sum(size), F.sum("n")).first())
        return check(dealt, sets, *rest)

    monkeypatch.setattr(ngram_join, "_join_tasks", joined)
    monkeypatch.setattr(ngram_join, "_possible_tasks", checked)
    pairs = [[" ".join([f"b{i}w{k}" for k in range(160)] + [f"{side}{i}w{k}" for k in range(40)]) for side in "cd"] for i in range(30)]
    texts = [t for pair in pairs for t in pair] + [pairs[0][0] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, words=1, num=90, den=100).collect()}
    assert got == {i: i for i in range(60)} | {60: 0}
    assert sum(made) <= 12
    assert all(size * 1.5 <= n for size, n in sent)


def test_sets_of_wanted_rows_only(spark, monkeypatch):
    """Rows are passed over before the join when their hash is not in the map; also rows with the same text as a wanted one."""
    made, keep = [], ngram_join.written

    def noted(df, label):
        out = keep(df, label)
        if label == "wanted":
            bits = ngram_join._row_map(out)
            rows = ngram_join.keyed(docs, "doc_id", "text").select("id", F.xxhash64("id", "tkey").alias("row")).collect()
            hit = ngram_join._mapped(np.array([r.row for r in rows], np.int64), bits)
            assert {r.id for r in out.collect()} <= {r.id for r, h in zip(rows, hit, strict=True) if h}
            made.append(int(hit.sum()))
        return out

    monkeypatch.setattr(ngram_join, "written", noted)
    near = " ".join(f"n{k}" for k in range(60))
    texts = [(i, " ".join(f"t{i}w{k}" for k in range(20))) for i in range(100)] + [(i, near) for i in range(100, 150)]
    texts += [(150, near + " end"), (None, near + " more"), (None, near + " more"), (151, None), (152, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs, words=1, num=90, den=100).collect()), key=str)
    assert got == sorted([(i, i) for i in (*range(100), 151, 152)] + [(i, 100) for i in (*range(100, 151), None, None)], key=str)
    assert made and 3 <= max(made) <= 6


def test_row_map_holds_all_rows(spark):
    rows = spark.createDataFrame([(str(k) if k % 3 else None, k * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63)) for k in range(3000)], "id string, tkey bigint")
    bits = ngram_join._row_map(rows.filter("tkey > 0"))
    hits = {}
    for r in rows.select("tkey", F.xxhash64("id", "tkey").alias("row")).collect():
        hits.setdefault(r.tkey > 0, []).append(bool(ngram_join._mapped(np.array([r.row], np.int64), bits)[0]))
    assert all(hits[True]) and sum(hits[False]) < 10
    none = ngram_join._row_map(rows.filter("id = 'x'"))
    assert not none.any() and none.nbytes == 4 << 20

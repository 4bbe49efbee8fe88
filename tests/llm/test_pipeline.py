import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from massif.llm import decontaminate, labelled, quality
from massif.llm.queries import ORACLE, QUERIES
from massif.llm.tables import read_table

from .brute import WORD, byte_strings, near_components, substring

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize(("name", "plain"), [("op1_ngram_jaccard_join", near_components), ("op3_substring_dedup", substring), ("op8_suffix_dedup", byte_strings)])
def test_queries_equal_brute_force(spark, name, plain):
    docs = read_table(spark, SF, "documents").orderBy("doc_id").collect()
    columns = {"op1_ngram_jaccard_join": ["n_shingles", "component_id"], "op3_substring_dedup": ["n_words", "n_removed", "kept_sha256"], "op8_suffix_dedup": ["n_bytes", "n_removed", "n_spans", "kept_sha256"]}[name]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()}
    want = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs]), strict=True))
    assert got == want


def test_every_stage_does_its_work(spark):
    docs = read_table(spark, SF, "documents")
    scored = quality.score_quality(docs, read_table(spark, SF, "labels"), labelled.fold("doc_id", 4) != 2)
    left = {r.doc_id: r.text for r in docs.join(scored, "doc_id").filter(F.col("score") >= quality.KEEP_FROM).select("doc_id", "text").collect()}
    best: dict[str, int] = {}
    for i, t in left.items():
        key = "".join(WORD.findall(t))
        best[key] = min(best.get(key, i), i, key=lambda j: (-len(left[j]), j))
    left = {i: left[i] for i in sorted(best.values())}
    ids = list(left)
    left = {i: left[i] for i, (_, root) in zip(ids, near_components(list(left.values()), 5, 8, 10), strict=True) if ids[root] == i}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, read_table(spark, SF, "benchmark")).collect()}
    left = {i: t for i, t in left.items() if i not in leaks}
    names = [n for n, _ in corpus_pipeline.STAGES]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, SF)
    assert names[-1] == "best_fit_packing"
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0

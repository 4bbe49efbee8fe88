from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from massif.llm import decontaminate, labelled, ngram_join, quality
from massif.llm.tables import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, n int"


def test_near_copies_leave_one_row_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (1, a + " end"), (None, b), (None, b + " end"), (None, c), (7, "one two"), (7, "three four"), (7, c + " more"), (None, ""), (None, ""), (9, "five six"), (9, "five six"), (None, "seven"), (None, "seven")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    b_rows = {(None, b), (None, b + " end")}
    assert sum(left.pop(r, 0) for r in b_rows) == 1
    assert left == Counter({(1, a + " end"): 1, (7, c + " more"): 1, (7, "one two"): 1, (7, "three four"): 1, (None, ""): 2, (9, "five six"): 1, (None, "seven"): 1})


def test_leaks_leave_other_rows_of_the_id(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, "start " + item), (None, "clean one"), (None, None), (4, item), (4, "clean two"), (5, "clean three")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [1, 2, 4, 5]


def test_rejected_rows_leave_other_rows_of_the_id(spark):
    docs = read_table(spark, SF, "documents")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.col("doc_id") % 7).otherwise(F.col("doc_id")).cast(docs.schema["doc_id"].dataType))
    scored = quality.score_quality(odd, read_table(spark, SF, "labels"), labelled.fold("doc_id", 4) != 2, key_col="text")
    want = Counter(r.text for r in scored.filter(F.col("score") >= quality.KEEP_FROM).collect())
    kept = corpus_pipeline.keep_good(spark, odd, SF)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == want and 0 < sum(want.values()) < docs.count()

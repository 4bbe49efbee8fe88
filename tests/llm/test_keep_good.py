from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_texts_stay_where_they_are_scored(spark):
    """Rows are kept by the score that stands beside them; no join or shuffle takes the texts along."""
    docs = corpus_pipeline.read_table(spark, SF, "documents").select("doc_id", "text", F.lit(1).alias("score"), F.lit("x").alias("__quality"))
    kept = corpus_pipeline.keep_good(spark, docs, SF)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

"""A corpus classified, deduplicated, decontaminated and packed, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm import decontaminate, exact_dedup, labelled, ngram_join, packing, quality
from massif.llm.tables import fresh, read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier rejects go, whatever their ids; it learns from the rows that are not held out."""
    learn = labelled.fold("doc_id", 4) != 2
    found = fresh("quality", docs)
    scored = quality.score_quality(docs, read_table(spark, sf_dir, "labels"), learn, beside=found)
    return scored.filter(F.col(f"{found}.score") >= quality.KEEP_FROM).drop(found)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return ngram_join.drop_near_copies(docs, words=5, num=8, den=10)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"), least_words=1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in the training sequences."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.drop("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard_join", drop_near),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifier, the decomposition or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by digest: one row per distinct normalised
text with the row that stays. New documents are reduced to one representative per
digest (map-side combined, so a digest that a third of all rows share costs one row
per task), sort-merge anti-joined with the index, and the unseen ones appended.

Defined cases: a null text counts as empty, and all empty texts are equal; a null id is
an ordinary id that sorts after all others and is kept if it alone has its text; rows that
repeat id and text are copies of each other and one of them stays; an empty input adds
nothing. Other columns are passed over. A text already in the index keeps the document
named there, whatever its length; running the same documents again therefore changes
neither index nor decisions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm.tables import fresh, local_conf_int, stored, text_or_empty
from massif.session import scratch_path

#: The white space that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: str | Column = "text") -> Column:
    return F.translate(text_or_empty(text), BLANKS, "")


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, as bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A Parquet table at ``path``, bucketed and sorted by digest, under ``table`` in this session's catalog."""

    table: str
    path: str
    id_type: str
    buckets: int


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
    """Open the index at a shared path, or begin one there.

    ``buckets`` is fixed when an index is begun and has to be named again when it is
    opened elsewhere; by default it is the session's number of shuffle partitions.
    """
    buckets = buckets or local_conf_int(spark, "spark.sql.shuffle.partitions", 200)
    table = "digest_index_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_").replace(".", "_")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{table}` (digest BINARY, keep_id {id_type}) USING parquet"
        f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return DigestIndex(table, path, id_type, buckets)


def append_new(spark: SparkSession, winners: DataFrame, index: DigestIndex) -> None:
    """Append the representatives whose digest the index lacks."""
    held = spark.table(index.table).select("digest")
    unseen = winners.select("digest", "keep_id").join(held.hint("merge"), "digest", "left_anti")
    (
        unseen.repartition(index.buckets, "digest")
        .write.format("parquet").mode("append").bucketBy(index.buckets, "digest").sortBy("digest").saveAsTable(index.table)
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, digest.

    ``group_size`` counts the rows of this input with the text. Without ``index`` a new
    one is begun in the shared folder.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    if index is None:
        index = open_index(spark, scratch_path(spark, "digests"), id_type)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            digest(text_col).alias("digest"),
            F.length(text_or_empty(text_col)).alias("points"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digested",
    )
    # the longest original first, then the smallest id, then one row of equal ones
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    winners = rows.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    winners = stored(winners.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "winners")
    append_new(spark, winners, index)
    known = spark.read.schema(spark.table(index.table).schema).parquet(index.path).select("digest", F.col("keep_id").alias("held_id"))
    groups = winners.join(known, "digest")
    same = F.col("held_id").eqNullSafe(F.col("keep_id"))
    # an indexed text keeps the indexed id; its row stays only if that very document is here again
    again = rows.groupBy("digest", "id").agg(F.min("row").alias("first_row"))
    earlier = groups.filter(~same).join(again, "digest").filter(F.col("id").eqNullSafe(F.col("held_id"))).select("digest", "first_row")
    groups = groups.join(earlier, "digest", "left").select(
        "digest",
        F.col("held_id").alias("keep_id"),
        F.when(same, F.col("keep_row")).otherwise(F.coalesce("first_row", F.lit(-1))).alias("keep_row"),
        "group_size",
    )
    # stored, so that the join exchanges both sides and a hot digest can be split
    groups = stored(groups, "groups")
    out = rows.join(groups, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    return out


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    found = exact_dedup(docs, None, id_col, text_col).filter("kept")
    d, i = fresh("digest", docs), fresh("id", docs)
    keep = found.select(F.col("digest").alias(d), F.col(id_col).alias(i))
    marked = docs.withColumn(d, digest(text_col))
    left = marked.join(keep.withColumnRenamed(d, f"{d}_k"), (F.col(d) == F.col(f"{d}_k")) & F.col(id_col).eqNullSafe(F.col(i)), "left_semi")
    # rows that repeat id and text pass the semi-join together: one of each stays
    repeats = marked.groupBy(d, id_col).count().filter("count > 1").select(F.col(d).alias(f"{d}_k"), F.col(id_col).alias(i))
    if repeats.isEmpty():
        return left.drop(d)
    match = (F.col(d) == F.col(f"{d}_k")) & F.col(id_col).eqNullSafe(F.col(i))
    single = left.join(repeats, match, "left_anti")
    return single.unionByName(left.join(repeats, match, "left_semi").dropDuplicates([d, id_col])).drop(d)

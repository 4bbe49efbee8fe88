"""A trie of the common beginnings of conversations, rolled up in bands of depths.

A node is a distinct sequence of first turns (role, text); the root is the empty one. A turn is known
by its SHA-256; a node's key is its depth and two sums of 60-bit hashes of (position, turn), so that
the keys of all prefixes are running sums, which are made in blocks of a conversation.

Totals of a subtree are sums over all its nodes. Depths are cut in bands of ``height``: in a band, a
node is sent to its ancestors of that band only, at most ``height`` of them. A band's top nodes
hang below nodes of the band above; once the whole total of such a top node is known, it is a
weight of the node that it hangs from, and one more exchange inside the bands finishes all nodes. The
totals of the top nodes are the same problem on a tree with ``height`` times fewer levels and are found
likewise, so depth d takes log d rounds to the base ``height``, in each of which a node is sent at most
``height`` times.

Defined cases: a null role or text is an empty one; a null position sorts first; rows of one
conversation with equal positions follow the digest of their turn; a null conversation id is a
conversation, the smallest member only where it is the only one, and written ``null``, last, in lists
of ends; rows that repeat are a turn each; conversations without turns are named by ``members`` and
end in the root; without any conversation there are no rows. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massif.llm.tables import stored

HEIGHT = 16
#: Turns of a conversation whose running sums one task makes.
BLOCK = 1024
KEY = ["depth", "k1", "k2"]
#: Keys are sums modulo this.
SPAN = 1 << 62
#: Characters of a list of ends that travel as one row.
PIECE_CHARS = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, digest, points): the turns of each conversation numbered from 1, with their digest and the code points of their text.

    Rows are dealt by ranges of conversation and order, so a conversation may lie in many tasks; each
    task numbers its own rows and adds what earlier tasks hold of the conversation.
    """
    said, speaker = (F.coalesce(F.col(c), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.length(speaker).cast("string"), F.lit(":"), speaker, said).cast("binary"), 256)
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("bigint").alias("points"), F.monotonically_increasing_id().alias("place")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("place")]
    dealt = stored(rows.repartitionByRange(F.col("conv").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv", "part").count().select("conv", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    sizes = sizes.filter("offset > 0").withColumnsRenamed({"conv": "c", "part": "p"})
    local = F.row_number().over(W.partitionBy("conv", "part").orderBy(*order))
    placed = dealt.withColumn("local", local).join(sizes, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return placed.select("conv", (F.col("local") + F.coalesce("offset", F.lit(0))).cast("bigint").alias("depth"), "digest", "points")


def rebuild(numbered: DataFrame, heads: DataFrame) -> DataFrame:
    """Numbered turns of conversations that begin with another one's.

    ``heads`` has one row (conv, head, take) per conversation: the first ``take`` turns of ``head`` (all
    if it has fewer, none if it is absent), then the conversation's own turns after its first ``take``.
    """
    sizes = numbered.groupBy("conv").agg(F.max("depth").alias("size")).withColumnRenamed("conv", "c")
    taken = F.least("take", F.coalesce("size", F.lit(0)))
    plan = stored(heads.join(sizes, F.col("head") == F.col("c"), "left").select("conv", "head", "take", taken.alias("taken")), "heads")
    of = plan.withColumnRenamed("conv", "c")
    own = numbered.join(of, F.col("conv").eqNullSafe(F.col("c")) & (F.col("depth") > F.col("take")))
    own = own.select("conv", (F.col("depth") - F.col("take") + F.col("taken")).alias("depth"), "digest", "points")
    opening = numbered.withColumnRenamed("conv", "h").join(of, (F.col("h") == F.col("head")) & (F.col("depth") <= F.col("take")))
    return own.unionByName(opening.select(F.col("c").alias("conv"), "depth", "digest", "points"))


def _prefixes(numbered: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, points): the key of the first ``depth`` turns, and that of one turn less."""
    mark = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"), 256)
    rows = numbered.select("conv", "depth", "points", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), mark.alias("mark"))
    rows = rows.select("*", *(F.conv(F.substring("mark", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"h{k + 1}") for k in (0, 1))).drop("mark")
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    blocks = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(f"s{k}").over(before).cast("decimal(38,0)"), zero).alias(f"base{k}") for k in (1, 2))
    ).filter("b > 0")
    inside = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select("*", *(F.sum(f"h{k}").over(inside).cast("decimal(38,0)").alias(f"sum{k}") for k in (1, 2)))
    sums = sums.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")

    def key(k: int, less: Column) -> Column:
        whole = F.coalesce(F.col(f"base{k}"), zero) + F.col(f"sum{k}") - less
        return (whole % F.lit(SPAN).cast("decimal(20,0)")).cast("bigint")

    return sums.select(
        "conv", "depth", *(key(k, zero).alias(f"k{k}") for k in (1, 2)), *(key(k, F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)), "points"
    )


def _of(name: str, columns: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{name}_{c}") for c in columns]


def roll_up(paths: DataFrame, nodes: DataFrame, weights: list[str], height: int = HEIGHT) -> DataFrame:
    """Sums of ``weights`` over the subtree of each node: KEY and the weights.

    ``paths`` has the nodes (conv, KEY) of every conversation at all depths from 0 on; ``nodes`` has KEY,
    ``rep``, one of the conversations through it, and the node's own weights.
    """
    band = F.floor(F.col("depth") / height)
    within = W.partitionBy("conv", band).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    up = paths.withColumn("up", F.collect_list(F.struct(*KEY)).over(within))
    at = [F.col(c) == F.col(f"n_{c}") for c in KEY]
    own = nodes.select(*_of("n", KEY), "rep", *weights)
    here = stored(up.join(own, [*at, F.col("conv").eqNullSafe(F.col("rep"))]).select(*KEY, "rep", "up", *weights), "bands")

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(*(F.sum(w).alias(w) for w in weights))

    deepest = here.agg(F.max("depth")).first()[0]
    if deepest is not None and deepest >= height:
        # the tree of the bands' top nodes, each with the own weights of its band's part of the subtree
        tops = F.col("up")[0]
        upper = sums(here.select(*(tops[c].alias(c) for c in KEY), *weights))
        level = [(F.col("depth") / height).cast("bigint").alias("depth"), "k1", "k2"]
        reps = here.filter(F.col("depth") % height == 0).select(*_of("n", KEY), "rep")
        top_nodes = stored(upper.join(reps, at).select(*level, "rep", *weights), "tops")
        top_paths = paths.filter(F.col("depth") % height == 0).select("conv", *level)
        totals = roll_up(top_paths, top_nodes, weights, height).withColumn("depth", F.col("depth") * height).filter("depth > 0")
        # the node right above a top node, on the path of the conversation that stands for it
        known = totals.join(reps, at).select("rep", F.col("depth").alias("below"), *weights)
        above = paths.filter(F.col("depth") % height == height - 1)
        hung = above.join(known, F.col("conv").eqNullSafe(F.col("rep")) & (F.col("depth") == F.col("below") - 1)).select(*KEY, *weights)
        full = sums(nodes.select(*KEY, *weights).unionByName(hung)).select(*_of("n", KEY), *weights)
        here = here.drop(*weights).join(full, at)
    return stored(sums(here.select(F.explode("up").alias("a"), *weights).select("a.*", *weights)), "totals")


def ends_digests(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of (conv, KEY): the ids of each node in ascending order, joined by commas, hashed.

    Tasks join the ids of their range to long strings, and these are hashed one after the other, so
    no list is ever held as a whole.
    """
    order = [*KEY, F.col("conv").asc_nulls_last()]
    sorted_ = ends.select(*KEY, "conv").repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            ids = ["null" if i is None else str(i) for i in batch.column(3).to_pylist()]
            rows, lo, held = [], 0, 0
            for k in range(len(keys)):
                held += len(ids[k]) + 1
                if k + 1 == len(keys) or keys[k + 1] != keys[k] or held > PIECE_CHARS:
                    rows.append((*keys[k], part, seq, ",".join(ids[lo : k + 1])))
                    lo, held, seq = k + 1, 0, seq + 1
            yield pa.RecordBatch.from_pylist([dict(zip(PIECES.names, r, strict=True)) for r in rows], PIECES)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True):
                if key != last:
                    if last is not None:
                        done.append((*last, running.hexdigest()))
                    last, running = key, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, r, strict=True)) for r in done], DIGESTS)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, (*last, running.hexdigest()), strict=True))], DIGESTS)

    key_types = "depth bigint, k1 bigint, k2 bigint"
    pieces = sorted_.mapInArrow(join, f"{key_types}, part bigint, seq bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part", "seq").mapInArrow(digest, f"{key_types}, ends_sha256 string")


_KEYS = [(c, pa.int64()) for c in KEY]
PIECES = pa.schema([*_KEYS, ("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([*_KEYS, ("ends_sha256", pa.string())])


def prefix_trie(numbered: DataFrame, members: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of numbered turns.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, the code points of a node's last text for each member but one) and ends_sha256.
    ``members`` (conv) names conversations that may have no turns. ``height`` is the height of a band.
    """
    prefixes = stored(_prefixes(numbered), "prefixes")
    convs = prefixes.select("conv")
    convs = (convs if members is None else convs.unionByName(members.select("conv"))).distinct()
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv", *(zero.alias(c) for c in KEY))
    paths = prefixes.select("conv", *KEY).unionByName(roots)
    ends = paths.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("end")).select("conv", "end.*")
    # -- nodes: members, parent, own weights
    none = F.lit(None).cast("bigint")
    rows = prefixes.unionByName(roots.select("*", none.alias("p1"), none.alias("p2"), zero.alias("points")))
    nodes = rows.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("n_depth"), F.col("p1").alias("n_k1"), F.col("p2").alias("n_k2")).agg(F.count("*").alias("n_children"))
    at = [F.col(c) == F.col(f"n_{c}") for c in KEY]
    nodes = nodes.join(children, at, "left").drop(*(f"n_{c}" for c in KEY)).withColumn("n_children", F.coalesce("n_children", zero))
    own = nodes.select(*KEY, "rep", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    totals = roll_up(paths, own, ["n_leaves", "saved_tokens"], height)
    # -- what each node shows
    nodes = nodes.join(totals, KEY).join(ends_digests(ends), KEY, "left")
    above = nodes.select(*_of("n", KEY), F.col("rep").alias("parent_rep"))
    up = (F.col("depth") - 1 == F.col("n_depth")) & (F.col("p1") == F.col("n_k1")) & (F.col("p2") == F.col("n_k2"))
    return nodes.join(above, up, "left").select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent_rep").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )

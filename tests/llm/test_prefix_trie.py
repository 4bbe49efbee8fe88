from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from massif.llm import prefix_trie

TURNS = "conv_id bigint, turn int, role string, text string, depth string, conv double, k1 int"


def digest(turn: tuple) -> str:
    role, text = turn[1] or "", turn[2] or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def sequences(rows: list[tuple]) -> dict:
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    for turns in convs.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))
    return {c: [(t[1] or "", t[2] or "") for t in turns] for c, turns in convs.items()}


def brute(convs: dict) -> set[tuple]:
    """All nodes of the conversations' trie, by their whole sequences."""
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    order = lambda c: (c is None, c or 0)
    low = {n: min(m, key=order) for n, m in members.items()}
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
            leaves[n[:d]] += children[n] == 0
    out = set()
    for n, m in members.items():
        ends = ",".join("null" if c is None else str(c) for c in sorted((c for c in m if len(convs[c]) == len(n)), key=order))
        parent = low[n[:-1]] if n else None
        out.add((low[n], len(n), parent, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def spread(rows: list[tuple]) -> list[tuple]:
    return [(*r, "x", 0.5, 7) for r in rows]


def found(df) -> set[tuple]:
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_trie_of_deep_and_odd_conversations(spark):
    deep = [(c, t, "user" if t % 2 else "assistant", f"said {t if t < cut else (c, t)}") for c, cut in ((1, 99), (2, 23), (3, 23), (4, 40), (5, 3)) for t in range(44)]
    odd = [(7, None, None, None), (7, 0, "user", None), (7, 0, "user", ""), (7, 0, "user", "é字😀"), (7, 0, "user", "é字😀"), (None, 1, "user", "nobody's"), (None, None, "a", "b")]
    same = [(c, 0, "user", "said 0") for c in range(20, 60)] + [(c, 0, "us", "ersaid 0") for c in (60, 61)]
    rows = deep + odd + same
    df = spark.createDataFrame(spread(rows), TURNS).repartition(5)
    members = spark.createDataFrame([(c,) for c in (100, 101, 7, 20)], "conv bigint")
    numbered = prefix_trie.number_turns(df)
    expected = sequences(rows) | {100: [], 101: []}
    want = brute(expected)
    for height in (2, 3, 16, 64):
        assert found(prefix_trie.prefix_trie(numbered, members, height)) == want


def test_running_sums_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = [(c, t, "user", f"{t}" if t < 8 or c < 3 else f"{c} {t}") for c in range(6) for t in range(10 + c % 2)]
    df = spark.createDataFrame(spread(rows), TURNS)
    assert found(prefix_trie.prefix_trie(prefix_trie.number_turns(df))) == brute(sequences(rows))


def test_numbering_of_one_conversation_in_many_tasks(spark):
    rows = [(1, t // 3 if t % 7 else None, "user", "again" if t % 2 else f"{t}") for t in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = prefix_trie.number_turns(spark.createDataFrame(spread(rows), TURNS)).orderBy("depth").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [r.depth for r in got] == list(range(1, 601))
    want = sorted(((r[1], r[2], r[3]) for r in rows), key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))
    assert [r.digest for r in got] == [digest(t) for t in want]


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c} {t}") for c, n in ((100, 2), (101, 9), (102, 1), (230, 4), (200, 7), (231, 9)) for t in range(n)]
    own = sequences(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    numbered = prefix_trie.number_turns(spark.createDataFrame(spread(rows), TURNS))
    conv = F.col("conv")
    heads = numbered.select("conv").distinct().select("conv", (conv - conv % 100).alias("head"), (F.crc32(conv.cast("string").cast("binary")) % 6).alias("take"))
    assert found(prefix_trie.prefix_trie(prefix_trie.rebuild(numbered, heads), heads, height=2)) == brute(want)


def test_long_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 50)
    rows = [(c, 0, "user", "hello") for c in range(1000)]
    got = prefix_trie.prefix_trie(prefix_trie.number_turns(spark.createDataFrame(spread(rows), TURNS))).filter("depth = 1").first()
    assert got.ends_sha256 == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


def test_no_conversation_gives_no_rows(spark):
    assert prefix_trie.prefix_trie(prefix_trie.number_turns(spark.createDataFrame([], TURNS))).count() == 0

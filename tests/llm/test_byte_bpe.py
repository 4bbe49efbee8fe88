from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from massif.llm import byte_bpe

DOCS = "doc_id bigint, text string, ids string, row int, decoded double"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference() -> tiktoken.Encoding:
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts() -> list[str | None]:
    rnd = random.Random(5)
    letters = "aab\n\r\t  é字😀​'sS1２,.\x00 ▁"
    mixed = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [None, "", " ", "<|endoftext|>", "a" * 50_000, " " * 3000, "字" * 2000, "it's  we'll\n\n\tgo 12345", *mixed]


def test_ids_are_those_of_the_rank_library(spark):
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, "x", i, 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], DOCS).repartition(3)
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    ref = reference()
    key = lambda r: (str(r[0]), r[1], r[2])
    want = [(d, ref.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in rows + rows[:3]]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_UNITS", 10)
    bpe, ref = byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN), reference()
    for text in odd_texts()[8:60]:
        assert bpe.encode([text])[0].tolist() == ref.encode_ordinary(text)
        assert len(bpe.units) <= 60


def test_unknown_and_null_ids_decode_to_nothing(spark):
    rows = [(1, [72, None, 99_999_999, -3, 50_256, 105]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").withColumn("decoded", F.lit(1))
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, PATH, public_tokenizers.PATTERN).collect()}
    ref = reference()
    assert got == {1: ref.decode_bytes([72, 105]), 2: b"", 3: b""}


def test_a_vocabulary_with_gaps_and_no_rows(spark, tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    lines = [base64.b64encode(t) + b" " + str(i + (10 if i > 255 else 0)).encode() for i, t in enumerate(tokens)]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(lines))
    bpe = byte_bpe.ByteBpe(str(path), r"\w+|\W+")
    assert bpe.encode(["abc abab bcbc"])[0].tolist() == [267, 32, 266, 266, 32, 268, 268]
    assert byte_bpe.encode(spark.createDataFrame([], DOCS), str(path), r"\w+|\W+").count() == 0
    path.write_bytes(lines[0])
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe(str(path), r"\w+|\W+")


def test_the_query_over_its_table(spark):
    import hashlib

    from massif.llm.queries import QUERIES

    folder, ref = "/root/testdata/sf0.001", reference()
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = ref.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op12_byte_bpe"](spark, folder).collect()} == want

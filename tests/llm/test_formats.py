import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massif.llm import chat_format, exact_dedup, packing, token_output
from massif.llm.tokenization import Encoder
from massif.session import scratch_path

DOCS = "doc_id bigint, text string, digest string, uid int, part int"
ODD = ["", "   ", " a  b   c \n\n d", "a \n b\n\n  c", "foo ", "foo\n ", "x\x1cy z", "I'm don't 'stop", "Á é 　 b   c", "é o", "\n\nx y", "a\t b", "ΣΑΣ ΌΣ, x²", "日本 語", "<|endoftext|> hi", "İx ıſ"]


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "x", 0, 0) for i, t in zip(ids, texts, strict=True)], DOCS)


# exact dedup


def test_copies_ignore_blanks_and_keep_the_longest(spark):
    docs = docs_of(spark, ["a b", "ab", "a  b", None, "", " \t\n\x0b\x0c\r", "c", "c"], [5, 1, 7, 9, 8, 10, 3, 3])
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {(5, 7, 3, False), (1, 7, 3, False), (7, 7, 3, True), (9, 10, 3, False), (8, 10, 3, False), (10, 10, 3, True)} < rows
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect())[1:3] == [(3, False), (3, True)]
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 10]


def test_null_ids_and_empty_table(spark):
    docs = docs_of(spark, ["x", "x", "y"], [None, 4, None])
    got = sorted((r.text, r.doc_id) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert got == [("x", 4), ("y", None)]
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_index_persists_over_batches(spark):
    index = exact_dedup.open_index(spark, scratch_path(spark, "index"), buckets=4)
    first = exact_dedup.exact_dedup(docs_of(spark, ["one", "two"], [1, 2]), index)
    assert sorted((r.doc_id, r.kept) for r in first.collect()) == [(1, True), (2, True)]
    batch = docs_of(spark, ["o n e", "three"], [0, 3])
    second = exact_dedup.exact_dedup(batch, index)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect()) == [(0, 1, False), (3, 3, True)]
    again = exact_dedup.exact_dedup(batch, exact_dedup.open_index(spark, index.path, buckets=4))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again.collect()) == [(0, 1, False), (3, 3, True)]
    assert spark.table(index.table).count() == 3


# chat formatting


def test_chats_are_read_back(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "\\", "\\n", "<\\|", "<\\\\|x", "", "line\nline", "<|im_start|>user\n", "|>", "\\\\<|"]
    rows = [(1, i, ("user", "assistant", "sy\\n\nstem<|")[i % 3], t) for i, t in enumerate(said)] + [(2, 0, None, None), (2, None, "assistant", "x"), (2, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("content", chat_format.text_content())
    out = chat_format.format_chats(turns)
    got = {r.conv_id: r for r in out.select("*", chat_format.read_turns().alias("turns"), chat_format.read_loss_text().alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[: len(said)]]
    assert got[1].loss == "".join(r[3] for r in rows[: len(said)] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "x"), ("", ""), ("assistant", "y")]
    for r in got.values():
        bodies = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(bodies) == sum(t.role == "assistant" for t in r.turns)
        assert all(r.formatted[s.start + s.length :].startswith("<|im_end|>\n") for s in r.loss_spans)


def test_parts_become_placeholders(spark):
    schema = "conv_id bigint, turn bigint, role string, content " + chat_format.CONTENT
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 900), ("audio", None, "b.wav", None), ("video", None, "c", None), None, (None, "end", None, None)]
    out = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [("document", None, "d.pdf", None)])], schema)).first()
    assert out.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|attachment|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n<|document|><|im_end|>\n"
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in out.attachments] == [(0, 1, "image", "a.png", 900), (0, 2, "audio", "b.wav", 128), (0, 3, "video", "c", 0), (2, 0, "document", "d.pdf", 512)]
    assert out.expanded_tokens == 1540
    assert chat_format.format_chats(spark.createDataFrame([], schema)).count() == 0


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + [a + " " + b for a in ODD for b in ODD] + ["".join(rng.choices("ab \n'é.<|0", k=60)) for _ in range(400)]
    for got, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for values in (
        np.zeros(1000, np.uint64), np.ones(61, np.uint64), np.zeros(0, np.uint64), rng.integers(0, 50000, 5000).astype(np.uint64),
        (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) - np.uint64(1), np.array([2**60 - 2, 2**60 - 1, 2**60, 2**64 - 1, 0], np.uint64),
        np.concatenate([np.zeros(239, np.uint64), [np.uint64(7)], np.zeros(300, np.uint64)]),
    ):
        words, escapes = token_output.encode_simple8b(values)
        assert (token_output.decode_simple8b(words, escapes, len(values)) == values).all()
    assert len(token_output.encode_simple8b(np.zeros(480, np.uint64))[0]) == 2


def test_written_tokens_are_read_back(spark):
    texts = [None, *ODD, "word " * 3000, "word " * 3000]
    ids = [None, *range(100, 100 - len(ODD), -1), 7, 7]
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks = token_output.write_tokens(docs_of(spark, texts, ids).repartition(3), path, block_ids=50)
    rows = sorted(token_output.read_tokens(blocks).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at = 0
    for row, (doc_id, text) in zip(rows, want, strict=True):
        raw = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids, row.ids_crc32) == (doc_id, at, len(raw) // 4, raw, zlib.crc32(raw))
        at += row.n_tokens
    assert token_output.read_tokens(token_output.write_tokens(docs_of(spark, []), path)).count() == 0


# packing


def test_plan_takes_every_length_once():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        lengths: dict[int, int] = {}
        for _ in range(rng.choice([5, 400])):
            n = rng.randint(1, capacity)
            lengths[n] = lengths.get(n, 0) + rng.choice([1, 1, 7, 1000])
        runs = packing.plan_sequences(lengths, capacity)
        taken: dict[int, int] = {}
        for times, members in runs:
            assert times > 0 and sum(members) <= capacity
            for n in members:
                taken[n] = taken.get(n, 0) + times
        assert taken == lengths
        total = sum(k * v for k, v in lengths.items())
        assert sum(t for t, _ in runs) <= 1.25 * total / capacity + 2


def test_complements_fill_exactly():
    assert packing.plan_sequences({6: 3, 4: 3, 5: 2, 3: 1, 2: 1}, 10) == [(3, (6, 4)), (1, (5, 5)), (1, (3, 2))]
    assert packing.plan_sequences({7: 2, 2: 1, 1: 4}, 10)[0] == (1, (7, 2, 1))
    assert sum(t for t, _ in packing.plan_sequences({5: 1, 3: 1, 1: 2, 10: 4}, 10)) == 5


def test_packed_pieces(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "hi", "word " * 900, "w " * 2047, "w " * 5000] + ["some text " * k for k in range(60)]
    pieces = packing.cut_pieces(docs_of(spark, texts).repartition(4), path, capacity=512)
    rows = packing.pack(pieces, 512).collect()
    library = Tokenizer.from_file(path)
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in mine) == ids.tobytes()
        assert [r.length for r in mine[1:]] == [512] * (len(mine) - 1)
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in mine)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(packing.cut_pieces(docs_of(spark, []), path)).count() == 0


def test_digest_is_of_the_normalised_text(spark):
    row = docs_of(spark, ["a é\tb"]).select(F.lower(F.hex(exact_dedup.digest())).alias("d")).first()
    assert row.d == hashlib.sha256("aéb".encode()).hexdigest()

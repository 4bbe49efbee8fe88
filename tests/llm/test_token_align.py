from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from massif.llm import token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, links int, a_ids string, id double"


def letters() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def brute(docs: list[tuple]) -> list[tuple]:
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    back = letters()
    a_bytes = {i: bytes(back[c] for c in t) for t, i in a_model.get_vocab().items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in range(b_model.vocab_size()))]
    tokens, links = [], Counter()
    for _, text in docs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            a, b = [], []
        a_end = {e: (k, i) for k, (e, i) in enumerate(zip(accumulate(len(a_bytes[i]) for i in a), a))}
        b_end = {e: (k, i) for k, (e, i) in enumerate(zip(accumulate(len(b_bytes[i]) for i in b), b))}
        cuts = sorted(a_end.keys() & b_end.keys())
        groups, pairs, x, y = [], [], 0, 0
        for e in cuts:
            (i, p), (j, q) = a_end[e], b_end[e]
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            pairs.append((p, q))
            x, y = i + 1, j + 1
        links.update(pairs)
        tokens.append((len(a), len(b), groups, pairs))
    best = Counter()
    for (_, q), n in links.items():
        best[q] = max(best[q], n)
    return [
        (d, na, nb, len(g), len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for (d, _), (na, nb, g, p) in zip(docs, tokens, strict=True)
    ]


def run(spark, docs: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(d, t, 1, "x", 0.5) for d, t in docs], DOCS).repartition(3)
    aligned = token_align.align(df, A, B)
    return [tuple(r) for r in token_align.score_links(aligned, token_align.link_counts(spark, aligned, A, B)).collect()]


def test_links_against_a_plain_count(spark):
    rnd = random.Random(3)
    alpha = "aab\n\r\t  é字😀​'sS1２,.\x00 <|endoftext|></s>"
    mixed = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts = [None, "", " ", "   ", "<|endoftext|>", "</s> <s><unk>", "a▁b", "\n\n  \t", "antidisestablishmentarianism " * 50, "x" * 20_000, "字" * 1000, "the cat", "the cat", *mixed]
    docs = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    docs += docs[:20]
    key = lambda r: tuple(map(str, r))
    assert sorted(run(spark, docs), key=key) == sorted(brute(docs), key=key)


def test_no_rows_and_no_tokens(spark):
    assert set(run(spark, [(None, None), (1, "")])) == {(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")}
    df = spark.createDataFrame([], DOCS)
    aligned = token_align.align(df, A, B)
    assert token_align.score_links(aligned, token_align.link_counts(spark, aligned, A, B)).count() == 0


def test_common_ends_of_random_lists():
    rnd = np.random.default_rng(1)
    for share in (0.02, 0.3, 0.9):
        a_all, b_all, a_bounds, b_bounds, base = [], [], [0], [0], 0
        for _ in range(40):
            n = int(rnd.integers(0, 300))
            if n:
                picks = [np.flatnonzero(rnd.random(n) < s) + 1 for s in (share, 0.5)]
                a, b = (np.unique(np.append(p, n)) + base for p in picks)
                a_all.append(a)
                b_all.append(b)
                base += n
            a_bounds.append(sum(map(len, a_all)))
            b_bounds.append(sum(map(len, b_all)))
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        i, j = token_align.common_ends(a, b, np.array(a_bounds), np.array(b_bounds))
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_the_query_over_its_table(spark):
    from massif.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_token_align"](spark, folder).collect()} == set(brute(docs))

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from massif.llm.queries import QUERIES
from massif.llm.tokenization import Encoder

TEXTS = ["<|endoftext|> hi", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> x", "plain text", "", "x <|endof text|>", "é <|endoftext|><|endoftext|>", "  <|startoftext|>  y 日本"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_equal_the_unmodified_library(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path, added=True), Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choices(["<|endoftext|>", "<|startoftext|>", " ", "word", "<|", "É", "\n"], k=12)) for _ in range(300)]
    for got, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_queries_match_added_tokens(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, size, end in (("op5_best_fit_packing", "byte_bpe_50k.json", "length", 0), ("op9_token_output", "word_bpe_49k.json", "n_tokens", 1)):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in enumerate(TEXTS)}
        got = {r.doc_id: (r[size], r.ids_crc32) for r in QUERIES[query](spark, str(tmp_path)).collect()}
        assert got == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in want.items()}

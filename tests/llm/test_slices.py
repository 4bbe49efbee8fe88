import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from massif.llm import token_align, tokenization

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts_of(n):
    random.seed(n)
    return [None, "", *(" ".join("".join(random.choices("abcdeést.", k=random.randint(1, 9))) for _ in range(60)) for _ in range(n)), None]


def counted(monkeypatch):
    """The sizes in bytes of what encoders are given from now on."""
    sizes, encode = [], tokenization.Encoder.encode
    monkeypatch.setattr(tokenization.Encoder, "encode", lambda self, texts: sizes.append(sum(len(t.encode()) for t in texts)) or encode(self, texts))
    return sizes


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_column_is_encoded_some_texts_at_a_time(monkeypatch, name):
    path, texts = public_tokenizers.path(name), texts_of(80)
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenization, "SLICE_BYTES", 2000)
    sizes = counted(monkeypatch)
    column = pa.array(["left out", *texts]).slice(1)
    got = list(tokenization.encode_column(path, column, True))
    assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(sizes) > 5 and max(sizes) <= 2000


def test_many_alignments_share_a_look_through_known_units(monkeypatch):
    texts = texts_of(80)
    both = token_align.aligner(A, B)
    whole = list(both.slices(pa.array(texts)))
    assert [(lo, hi) for lo, hi, _ in whole] == [(0, len(texts))]
    monkeypatch.setattr(token_align, "SLICE_BYTES", 2000)
    sizes = counted(monkeypatch)
    parts = list(both.slices(pa.array(["left out", *texts]).slice(1)))
    assert len(parts) > 5 and len(sizes) == 1
    assert [lo for lo, _, _ in parts] == [0, *(hi for _, hi, _ in parts[:-1])] and parts[-1][1] == len(texts)
    for k, column in enumerate(whole[0][2]):
        assert [x for _, _, columns in parts for x in columns[k].to_pylist()] == column.to_pylist()
    assert np.array(whole[0][2][5])[2:-1].all()

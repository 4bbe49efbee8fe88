import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from massif.llm import tokenization


class Counted:
    def __init__(self, model):
        self.model, self.names = model, []

    def tokenize(self, name):
        self.names.append(name)
        return self.model.tokenize(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_frequent_words_stay_known(name, monkeypatch):
    monkeypatch.setattr(tokenization, "CACHE_UNITS", 100)
    monkeypatch.setattr(tokenization, "CACHE_PIECES", 100)
    path = public_tokenizers.path(name)
    enc, library = tokenization.Encoder(path), Tokenizer.from_file(path)
    enc.model = counted = Counted(enc.model)
    new = lambda: "".join(random.choices("abcdefgh", k=12))
    random.seed(5)
    common = [new() for _ in range(20)]
    for _ in range(30):
        texts = [" ".join(["The", *common, *(new() for _ in range(30))]) + ".", "", "it's\n\tso  ", "x" * 70 + " é" * 3]
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(sum(x.endswith(word) for x in counted.names) for word in common) <= 3

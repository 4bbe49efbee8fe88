import numpy as np

from massif.llm import ngram_join


def colliding(bits: int) -> tuple[str, str]:
    """Two words whose hashes share their last ``bits`` bits."""
    names = np.char.add("w", np.arange(4_000_000).astype(str))
    raw = np.frombuffer(" ".join(names.tolist()).encode(), np.uint8)
    grams, _ = ngram_join._grams(raw, np.array([0, len(raw)]), 1)
    low = grams & np.uint64((1 << bits) - 1)
    order = np.argsort(low, kind="stable")
    same = np.flatnonzero(low[order][1:] == low[order][:-1])
    assert len(same)
    return str(names[order[same[0]]]), str(names[order[same[0] + 1]])


def test_words_whose_short_hashes_collide_are_told_apart(spark):
    a, b = colliding(40)
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, a), (3, b), (4, f"{b} {a} {b}")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.class_size, r.component_id) for r in ngram_join.near_duplicates(docs, words=1, num=90, den=100).collect()}
    assert got == {1: (2, 2, 1), 2: (1, 1, 2), 3: (1, 1, 3), 4: (2, 2, 1)}

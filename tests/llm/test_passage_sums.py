import numpy as np
import pyarrow as pa

from massif.llm import decontaminate
from massif.llm.text import text_chunks


def test_passages_of_all_sizes_grow_from_one_sum():
    words = [f"w{i % 50}" for i in range(300)]
    texts = pa.array([" ".join(words[:n]) for n in (0, 1, 8, 9, 17, 40, 48, 49, 300)])
    (_, _, data, offsets), = text_chunks(texts)
    got = decontaminate.Passages(data, offsets)
    sums = np.random.default_rng(1).random((len(got.step_start), 5)).astype(np.float32)
    for size, total in got.whole(sums):
        for first, row in zip(got.starts(size), total, strict=True):
            last = min(first + size, first + got.steps[got.step_doc[first]] - got.within[first])
            want = sums[first].copy()
            for k in range(first + 1, last):
                want += sums[k]
            assert (row == want).all()

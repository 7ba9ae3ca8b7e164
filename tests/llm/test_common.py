"""Slices of Arrow batches read like fresh ones."""

import pyarrow as pa
import pyarrow.compute as pc

from sparkgrove.llm import common


def test_slices_are_whole():
    texts = [None if i % 11 == 0 else f"Ab{i} É c" * (i % 7) for i in range(400)]
    batch = pa.record_batch({"text": pa.array(texts)})
    seen = []
    for part in common.slices(iter([batch]), limit=500):
        arr = common.text_or_empty(part.column("text"))
        assert pc.utf8_lower(arr).to_pylist() == [t.lower() for t in arr.to_pylist()]
        words, at = common.lower_words(arr)
        for t, a, b in zip(arr.to_pylist(), at[:-1], at[1:]):
            assert words[a:b].to_pylist() == "".join(c.lower() if c < "\x7f" else c for c in t).split()
        seen += part.column("text").to_pylist()
    assert seen == texts


def test_rolling_hash():
    import numpy as np

    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = common.RollingHash(data)
    at = h.of(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert at[0] == at[1] != at[2]

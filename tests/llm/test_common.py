"""Hashes of spans do not hang on where the bytes stand, and long data is hashed in blocks."""

import numpy as np


def test_span_hashes_in_blocks(monkeypatch):
    from tessera.llm import common as c

    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4900, 800))
    ends = starts + rng.integers(0, 90, 800)
    whole = c.span_hashes(data, starts, ends, 5)
    monkeypatch.setattr(c, "SPAN_BLOCK", 200)
    assert (c.span_hashes(data, starts, ends, 5) == whole).all()
    by = rng.permutation(800)
    assert (c.span_hashes(data, starts[by], ends[by], 5) == whole[by]).all()
    raw, seen = data.tobytes(), {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), whole.tolist()):
        assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen)
    assert (c.span_hashes(data, starts, ends, 6) != whole).any()
    assert len(c.span_hashes(data, starts[:0], ends[:0])) == 0
    assert c.span_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)).shape == (1,)

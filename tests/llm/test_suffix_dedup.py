"""Repeated passages against a dictionary of all 50-byte strings; suffix order and Kasai against plain sorting."""

import hashlib

import numpy as np


def brute(rows, length=50):
    seen = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = min(seen.get(w, k), k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < k:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_dictionary(spark):
    from tessera.llm.suffix_dedup import repeated_bytes

    rng = np.random.default_rng(8)
    vocab = ["the", "of", "é", "Erin", "walk", "a", "zu", "xyz"] + [f"v{i}" for i in range(60)]
    line, texts = "This very common line stands in a third of all the documents here. ", []
    for i in range(240):
        t = " ".join(rng.choice(vocab, int(rng.integers(1, 120))))
        if i % 3 == 0:
            t = t[:40] + line + t[40:]
        if i % 4 == 1 and texts:
            other = texts[int(rng.integers(len(texts)))]
            t = t + other[len(other) // 3 :] if i % 8 == 1 else other.replace("walk", "run", 2)
        texts.append(t)
    texts += [texts[3], texts[3], "", None, "z" * 300, "z" * 49, "y" + "z" * 60, "ab" * 200, texts[5] + texts[5], texts[9]]
    keys = list(map(int, rng.permutation(len(texts)) * 5 - 100))
    keys[7] = keys[20]
    rows = list(zip(keys, texts))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _t string")
    for shard_bytes in (4000, 1 << 23):
        got = sorted(tuple(r) for r in repeated_bytes(df, shard_bytes=shard_bytes).collect())
        assert got == brute(rows)
    assert repeated_bytes(df.limit(0)).collect() == []


def test_null_and_hot_keys_and_a_very_long_text(spark):
    """A null key is the smallest; rows of one key don't take from each other, however many shards they fill."""
    from tessera.llm.suffix_dedup import repeated_bytes

    rng = np.random.default_rng(3)
    some = lambda n: " ".join(map(str, rng.integers(0, 10**9, n)))
    passages = [some(12) for _ in range(6)]
    rows = [(None, passages[0]), (None, passages[0] + some(5)), (-(2**63), passages[0] + some(9)), (4, some(20_000) + passages[1])]
    rows += [(7, some(int(rng.integers(1, 60))) + passages[int(rng.integers(6))]) for _ in range(80)]
    rows += [(9, passages[k]) for k in range(6)] + [(9, passages[2]), (5, passages[1]), (7, passages[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    low = -(2**64)
    want = brute([(low if k is None else k, t) for k, t in rows])
    for shard_bytes in (3000, 1 << 22):
        got = sorted((low if r[0] is None else r[0], *r[1:]) for r in repeated_bytes(df, shard_bytes=shard_bytes).collect())
        assert got == want


def test_suffix_order_and_prefixes():
    from tessera.llm.suffix_dedup import kasai, sort_suffixes

    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    starts = np.unique(np.r_[np.arange(0, 600), np.arange(900, 1500), rng.integers(0, 2900, 200)])
    got = sort_suffixes(data, starts, 50)
    raw = data.tobytes()
    assert got.tolist() == sorted(starts.tolist(), key=lambda i: (raw[i : i + 50], i))
    lcp = kasai(data, starts, got, 50)
    for k in range(1, len(got)):
        a, b = raw[got[k - 1] : got[k - 1] + 50], raw[got[k] : got[k] + 50]
        assert lcp[k] == next((i for i in range(50) if a[i] != b[i]), 50)

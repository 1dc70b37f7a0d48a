"""Fingerprints with edits against plain Python, and block tables against all pairs."""

import hashlib
import re

import numpy as np
import xxhash


def plain(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    total, votes = sum(map(len, words)), [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for i in range(64):
            votes[i] += len(w) * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_against_plain(spark, monkeypatch):
    from tessera.llm import fingerprints as m

    monkeypatch.setattr(m, "ranges_for", lambda df: 4)
    rng = np.random.default_rng(10)
    vocab = ["the", "Où", "élan", "x1", "walk,", "ÄÖ"] + [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 60, 40)] + [None, "", "...", "one", "𝒳y z"]
    texts += [texts[0]] * 3
    keys = [int(k) for k in rng.permutation(len(texts)) ** 2 * 3 - 50]
    df = spark.createDataFrame([(k, t, 1) for k, t in zip(keys, texts)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r for r in m.document_fingerprints(df).collect()}
    rows = sorted((k, t or "") for k, t in zip(keys, texts))
    prints = [plain(t) for _, t in rows]
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{prints[i]:016x}", f"{plain(edited):016x}")
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert r["near_edited"] == like(prints[i], plain(edited)) and r["near_next"] == like(prints[i], prints[(i + 1) % len(rows)])
        assert r["n_near"] == sum((prints[i] ^ p).bit_count() <= 3 for p in prints) - 1
    assert m.document_fingerprints(df.limit(0)).collect() == []
    assert m.document_fingerprints(df.filter("doc_id = %d" % rows[5][0])).collect()[0]["near_next"] == 1.0


def test_null_and_hot_keys_an_outlier_and_a_long_text(spark, monkeypatch):
    """Rows go by key, null first, and then by hash of the text, however the keys are spread."""
    from pyspark.sql import functions as F

    from tessera.llm import fingerprints as m

    monkeypatch.setattr(m, "ranges_for", lambda df: 5)
    rows = [(None, f"null {i}") for i in range(8)] + [(7, f"seven {i} here") for i in range(30)] + [(7, "same"), (7, "same"), (2**62, "far away"), (8, "long wörds " * 60_000)] + [(i, f"t {i}") for i in range(5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _b long")
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for i, (k, t) in enumerate(line):
        other, q = line[(i + 1) % len(line)][1], len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        want.append((str(k), f"{plain(t):016x}", f"{plain(edited):016x}", hashlib.sha256(edited.encode()).hexdigest()))
    got = m.document_fingerprints(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) for r in got) == sorted(want)


def test_block_tables_find_all(spark):
    from tessera.llm.fingerprints import near_classes

    rng = np.random.default_rng(11)
    base = rng.integers(-(2**62), 2**62, 20)
    prints = [int(b) ^ sum(1 << int(i) for i in rng.integers(0, 62, int(rng.integers(0, 5)))) for b in base for _ in range(8)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["n_near"] for r in near_classes(df).collect()}
    assert got == {p: sum(((p ^ q) & (2**64 - 1)).bit_count() <= 3 for q in prints) - 1 for p in prints}

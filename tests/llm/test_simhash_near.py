"""SimHash near-duplicates against all pairs."""

import re

import numpy as np
import xxhash


def brute(rows, radius=2):
    prints = {}
    for d, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    part = {d: d for d in prints}
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and part[a] != part[b]:
                lo, hi = sorted((part[a], part[b]))
                part = {k: lo if v == hi else v for k, v in part.items()}
    return {d: (f"{prints[d]:016x}", part[d]) for d in ids}


def test_against_all_pairs(spark):
    from tessera.llm.simhash_near import near_duplicates

    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)] + ["É", "A.b", "Z"]
    rows, base = [], [" ".join(rng.choice(vocab, 150)) for _ in range(12)]
    for i in range(160):
        words = base[i % 12].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
        rows.append((i * 7 - 50, " ".join(words) if i % 3 else "\t" + " \n".join(words).upper()))
    rows += [(5001, None), (5002, ""), (5003, "one"), (5004, "one two"), (5005, " ")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, fp long")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).collect() == []


def test_null_and_equal_keys_and_a_long_text(spark):
    from tessera.llm.simhash_near import near_duplicates

    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(2, "a b c d"), (2, "completely other words here"), (None, "a b c d"), (None, "alone"), (7, "a b c d"), (7, "a b c d"), (9, long), (4, long)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 2), (2, 2), (None, 2), (None, None), (7, 2), (7, 2), (9, 4), (4, 4)], key=str)


def test_forest_of_large_buckets(monkeypatch):
    from tessera.llm import simhash_near

    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, (400, 4)).astype(np.uint64)).sum(1, dtype=np.uint64))[:, None]
    dense = simhash_near.forest(prints, 2)
    monkeypatch.setattr(simhash_near, "DENSE", 10)
    assert len(simhash_near.forest(prints, 2)) == len(dense)

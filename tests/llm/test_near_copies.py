"""The near-copy stage against brute force over all pairs: large groups, and edits at the border of the likeness."""

import numpy as np
import pytest


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_force(texts):
    """Smallest row of each row's group."""
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def found(spark, texts):
    from tessera.llm.near_copies import deduplicated

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in deduplicated(docs).collect())


def kept(texts):
    return [i for i, r in enumerate(brute_force(texts)) if i == r]


@pytest.mark.parametrize("shingles", [4 << 20, 6000])
def test_group_of_hundreds_of_copies(spark, monkeypatch, shingles):
    from tessera.llm import near_copies

    monkeypatch.setattr(near_copies, "CLOUD_SHINGLES", shingles)  # the cloud is whole, and in blocks
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(400):  # some within 0.8 of the base or each other only, some of nothing
        w, edits = list(base), int(rng.integers(1, 6))
        for k, at in enumerate(rng.integers(0, len(w), edits)):
            w[at] = f"x{i}-{k}"
        texts.append(" ".join(w))
    for _ in range(120):  # the same set of words in another order: passages moved about
        cuts = np.sort(rng.choice(np.arange(5, 115), int(rng.integers(2, 6)), replace=False))
        parts = np.split(np.array(base), cuts)
        texts.append(" ".join(np.concatenate([parts[k] for k in rng.permutation(len(parts))])))
    want = kept(texts)
    assert 5 < len(want) < 500
    assert found(spark, texts) == want


def test_passages_added_cut_and_replaced_at_the_border(spark):
    rng = np.random.default_rng(6)
    texts, j = [], 0
    for n in (40, 100, 300):
        for like in (0.78, 0.8, 0.81, 0.83, 0.85):
            for kind in range(4):
                for _ in range(4):
                    j += 1
                    base = [f"d{j}-{i}" for i in range(n)]
                    m = n - 4  # shingles
                    new = lambda k, j=j: [f"e{j}-{i}" for i in range(k)]
                    more = int(m / like) - m
                    inner = max(1, int(m * (1 - like) / (1 + like)) - 4)
                    at = int(rng.integers(5, n - inner - 5))
                    copy = [base + new(more), new(more) + base, base[: n - int(m * (1 - like) + 1e-9)], base[:at] + new(inner) + base[at + inner :]][kind]
                    texts += [" ".join(base), " ".join(copy)]
    want = kept(texts)
    assert 20 < len(texts) - len(want) < len(texts) // 2
    assert found(spark, texts) == want


def test_texts_without_words_and_short_ones(spark):
    texts = ["", " ", "one", "ONE", "one two", "one two three four five", "one two three four five", None]
    assert found(spark, texts) == [0, 2, 4, 5]


def test_rows_are_judged_by_their_texts(spark):
    """Equal keys with other texts are other documents; equal rows share their fate; a null key is the largest."""
    from tessera.llm.near_copies import deduplicated, near_copies

    words = lambda p, n=40: " ".join(f"{p}{i}" for i in range(n))
    t, u, v, w = words("t"), words("u"), words("v"), words("w")
    rows = [(1, t), (2, t), (2, u), (None, v), (None, w), (3, w + " more"), (5, t + " more"), (4, v.upper()), (7, "x"), (7, "x"), (None, None), (8, ""), (9, words("long", 60_000)), (6, words("long", 59_000))]
    df = spark.createDataFrame([(k, x, "a", i) for i, (k, x) in enumerate(rows)], "doc_id long, text string, _h string, stays long")
    got = sorted(r["stays"] for r in deduplicated(df).collect())
    assert got == [0, 2, 5, 7, 8, 9, 11, 13]
    fate = {(r["doc_id"], r["component_id"]) for r in near_copies(df).collect()}
    assert {(1, 1), (2, 1), (2, 2), (5, 1), (None, 3), (None, 4), (9, 6), (None, 8)} <= fate
    assert deduplicated(df.limit(0)).collect() == []


def test_strangers_that_share_keys_make_no_clouds(spark):
    """Texts of one key that are otherwise others do not grow together, however many there are."""
    from pyspark.sql import functions as F

    from tessera.llm import near_copies as nc

    rng = np.random.default_rng(8)
    sketches = [nc.sketch(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(600)]
    assert len(sketches[0]) * 8 == nc.BITS
    keyed = spark.createDataFrame([(1, i, 300, bytearray(s)) for i, s in enumerate(sketches)], "key long, rep long, n int, sketch binary")
    assert nc.candidate_links(keyed, least=0.8).count() == 0
    one = keyed.unionByName(keyed.filter("rep = 7").select(F.lit(9).cast("long").alias("key"), "rep", "n", "sketch"))
    assert sorted(map(tuple, nc.shared_keys(one).collect())) == [(1, i) for i in range(600)]


def test_sketch_is_the_majority_of_each_bit():
    from tessera.llm import near_copies as nc
    from tessera.llm.common import mix64

    for n in (1, 254, 256, 20_000):
        h = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        bits = np.unpackbits(mix64(h[:, None] ^ nc.MIXED).view(np.uint8).reshape(n, -1), axis=1)
        assert nc.sketch(h) == np.packbits(2 * bits.sum(0, dtype=np.int64) > n).tobytes()


def test_deletion_variants_link_close_fingerprints(spark):
    from tessera.llm.near_copies import print_links

    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        base = rng.integers(0, 256, 32, dtype=np.uint8)
        for flips in (0, 1, 2, 3):
            bits = np.unpackbits(base)
            bits[rng.choice(64, flips, replace=False)] ^= 1
            bits[64:] = rng.integers(0, 2, len(bits) - 64)  # the other bits do not count
            rows.append((len(rows), bytearray(np.packbits(bits).tobytes())))
    words = np.array([np.frombuffer(bytes(x[:8]), np.uint64)[0] for _, x in rows])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(pairs):
        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(rows))]

    far = np.bitwise_count(words[:, None] ^ words[None])
    want = join((int(a), int(b)) for a, b in zip(*np.nonzero(far <= 2)))
    got = list(map(tuple, print_links(spark.createDataFrame(rows, "rep long, sketch binary")).collect()))
    assert all(a > b and far[a, b] <= 2 for a, b in got)
    parent[:] = range(len(rows))
    assert join(got) == want and len(set(want)) < len(rows) // 2

"""HyperMinHash near-duplicates against brute force over all pairs of sets, and the registers against plain Python."""

import numpy as np
import pytest


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_force(rows):
    """(key, set size, component, kept) of rows (key, text) with distinct keys."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(s), least[root(i)], k == least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(spark, rows, **options):
    from tessera.llm.hyper_minhash import near_duplicates

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus(seed, groups=25, lone=60):
    """Bases of 2 to 400 words, each with copies edited around the border of the likeness; common words throughout."""
    rng, texts = np.random.default_rng(seed), []
    for g in range(groups):
        size = int(rng.choice([2, 3, 4, 5, 6, 8, 11, 20, 26, 33, 60, 150, 400]))
        base = [f"c{rng.integers(20)}" if rng.random() < 0.5 else f"w{g}-{i}" for i in range(size)]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 2 + size // 12))):
                at = int(rng.integers(len(w)))
                kind = rng.integers(3)
                w[at : at + (kind != 1)] = [f"x{rng.integers(10**6)}"] if kind < 2 else []
                w = w or ["a"]
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    texts += [" ".join(f"c{x}" for x in rng.integers(20, size=int(rng.integers(1, 12)))) for _ in range(lone)]
    order = rng.permutation(len(texts))
    return [(int(k), texts[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("options", [{}, {"deviations": None}, {"limit": 3}])
def test_against_brute_force(spark, options):
    rows = [*corpus(7), (900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (-5, "one")]
    want = brute_force(rows)
    assert 40 < sum(r[3] for r in want) < len(rows) - 40
    assert found(spark, rows, **options) == want


def test_group_of_hundreds_and_hot_shingle(spark):
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join([*base[: i % 90], f"n{i}", *base[i % 90 :]])) for i in range(300)]
    rows += [(1000 + i, f"all rights reserved by n{i} and m{i}") for i in range(300)]  # one line with a very common pair
    assert found(spark, rows, limit=50) == brute_force(rows)


def test_rows_judged_by_their_texts(spark):
    from tessera.llm.hyper_minhash import near_duplicates

    long = " ".join(f"v{i % 977}-{i}" for i in range(200_000))
    rows = [(None, "a b c d", 1), (4, "a b c d", 2), (4, "a b c d", 3), (4, "p q r s", 4), (None, "lone text here", 5), (9, long, 6), (8, long + " end", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    want = [(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (4, 3, 4, True), (None, 2, None, True), (9, 199_999, 8, False), (8, 200_000, 8, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_registers():
    from tessera.llm.hyper_minhash import BUCKETS, MANTISSA, compressed, likeness, registers

    rng = np.random.default_rng(3)
    rest = np.sort(np.r_[rng.integers(0, 1 << 53, 2000), rng.integers(0, 1 << 20, 200), 0, 1, 2, (1 << 53) - 1].astype(np.uint64))
    got = compressed(rest)
    assert (np.diff(got.astype(int)) >= 0).all()
    for x, r in zip(rest.tolist(), got.tolist(), strict=True):
        x |= 1
        zeros = 53 - x.bit_length()
        behind = x << (zeros + MANTISSA + 1) >> 53 & ((1 << MANTISSA) - 1)
        assert (53 - (r >> MANTISSA), r & ((1 << MANTISSA) - 1)) == (zeros, behind)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (0, 1, 5, 3000)]
    regs = registers(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    assert (regs[0] == 0).all() and (regs[1] > 0).sum() == 1 and (regs[3] > 0).sum() == BUCKETS
    for s, r in zip(sets, regs, strict=True):
        for b in range(BUCKETS):
            own = [x for x in s.tolist() if x >> 57 == b]
            assert r[b] == (compressed(np.array([min(own) << 7 & (2**64 - 1)], np.uint64) >> np.uint64(11))[0] if own else 0)
    # the estimate of sets of known likeness, and of sets with nothing in common, lies around the truth
    for both, n in ((800, 900), (0, 50_000), (5000, 10_000)):
        seen = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            two = [np.sort(h[:n]), np.sort(h[n - both :])]
            a, b = registers(np.concatenate(two), np.array([0, n, 2 * n]))
            seen.append(float(likeness(a, b, n, n)[0]))
        assert abs(np.mean(seen) - both / (2 * n - both)) < 0.02


def test_registered_query(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    rows = corpus(11, groups=12, lone=20)
    spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_hyper_minhash"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute_force(rows)

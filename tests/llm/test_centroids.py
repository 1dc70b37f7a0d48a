"""Exact k-means against plain Python integers, at magnitudes on both sides of float64 and of a long."""

import hashlib
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

LONG_MAX = 2**63 - 1


def whole(x, scale=1024):
    return floor(x * scale) if isfinite(x * scale) else int(x) * scale


def plain(rows, dims, k=8, rounds=10, seed=3):
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        to = assigned()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, to, strict=True) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = [(min(d, LONG_MAX), j) for d, j in assigned()]
    each = [min(LONG_MAX, sum(d for d, c in to if c == j)) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, j, d, each[j], min(LONG_MAX, sum(d for d, _ in to)), digest[j]) for (i, _), (d, j) in zip(kept, to, strict=True))


def found(spark, rows, **options):
    from tessera.llm.centroids import clustered

    kind = "array<float>" if options.pop("single", False) else "array<double>"
    return sorted(tuple(r) for r in clustered(spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3), **options).collect())


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e30, 1e306])
def test_magnitudes(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * (scale if i % 5 == 0 else 1)).tolist()) for i in range(120)]
    rows += [(500, rows[0][1]), (501, rows[7][1]), (502, [0.0] * 6), (503, [-0.0004] * 6)]
    assert found(spark, rows, dims=6, rounds=4) == plain(rows, 6, rounds=4)


def test_contract_size_and_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).astype(np.float32).astype(float).tolist()) for i in range(300)]
    want = plain(rows, 64)
    assert found(spark, rows, single=True) == want
    assert found(spark, rows[::-1]) == want


def test_left_out_and_repeated(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, None), (7, []), (1, [1.0, 2.0]), (1, [9.0, 9.0]), (8, [1.0, 2.0])]
    assert found(spark, rows, dims=2) == plain(rows, 2)
    assert len(found(spark, rows, dims=2)) == 4
    assert found(spark, rows[1:7], dims=2) == []
    assert found(spark, [], dims=2) == []


def test_null_keys_and_clashing_columns(spark):
    from tessera.llm.centroids import clustered

    rows = [(None, [1.0, 1.0], 1, 1), (None, [5.0, 5.0], 2, 2), (3, [1.0, 1.5], 3, 3)]
    got = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, key int"), dims=2, k=2)
    assert sorted(((r["vec_id"], r["distance"] >= 0) for r in got.collect()), key=str) == [(3, True), (None, True), (None, True)]


def test_distances_are_exact_at_the_bound():
    from tessera.llm.centroids import squared_distances

    rng = np.random.default_rng(5)
    for top in (2**20, 2**22, 2**23, 2**24, 2**28, 2**40, 2**70):
        x = np.array([[int(v) * top // 2**20 for v in row] for row in rng.integers(-(2**20), 2**20 + 1, (9, 64))], object)
        c = np.array([[int(v) * top // 2**20 for v in row] for row in rng.integers(-(2**20), 2**20 + 1, (4, 64))], object)
        want = [[sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in c.tolist()] for r in x.tolist()]
        held = (x.astype(np.float64), c.astype(np.float64)) if top < 2**53 else (x, c)
        assert squared_distances(*held).tolist() == want


def test_scale_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        found(spark, [(1, [1.0])], dims=1, scale=1000)

"""Scans over cells on several levels, runs with nulls, exact percentiles, cuts and nearest vectors against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["sum", "max"])
def test_running_on_many_levels(spark, monkeypatch, kind):
    from tessera.operators import frame

    monkeypatch.setattr(frame, "LEVEL", 3)
    rng = np.random.default_rng(2)
    values = [None if rng.random() < 0.3 else int(rng.integers(-5, 9)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "cell long, v long")
    got = [r["b"] for r in frame.running(df, "cell", "v", "b", kind).orderBy("cell").collect()]
    for i, b in enumerate(got):
        before = [v for v in values[:i] if v is not None]
        assert b == ((sum(before) if kind == "sum" else max(before)) if before else None)


def test_runs_over_cells_and_nulls(spark):
    from tessera.operators.advantages import run_numbers

    rng = np.random.default_rng(3)
    keys = [None if k == 3 else "abc"[k] for k in np.repeat(rng.integers(0, 4, 90), rng.integers(1, 400, 90))]
    want, n = [], 0
    for i, k in enumerate(keys):
        n = n + 1 if i and k == keys[i - 1] else 0
        want.append(n)
    assert len(keys) > 3 * 4096
    df = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    assert [r["run_no"] for r in run_numbers(df, "k", "i").orderBy("i").collect()] == want


def test_exact_percentiles(spark):
    from tessera.operators.metrics import exact_percentiles

    rng = np.random.default_rng(4)
    values = [*rng.normal(size=301), *rng.integers(0, 4, 200).astype(float)]
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)] + [(None, 0)], "v double, g long")
    shares = (0.0, 0.05, 0.5, 0.77, 1.0)
    assert exact_percentiles(df, "v", shares).first()[:] == pytest.approx(np.percentile(values, [100 * s for s in shares]).tolist())
    for r in exact_percentiles(df, "v", shares, ["g"]).collect():
        assert r[1:] == pytest.approx(np.percentile(values[r["g"] :: 3], [100 * s for s in shares]).tolist())


def test_smallest_token_with_ties(spark):
    from tessera.operators.tokens import smallest

    rng = np.random.default_rng(5)
    rows = [(int(r), int(p), float(rng.integers(-3, 3)) / 7 + (1e-300 if rng.random() < 0.1 else 0.0)) for r in range(40) for p in range(9)]
    df = spark.createDataFrame(rows, "row_id long, pos long, key double")
    ranked = sorted((k, r, p) for r, p, k in rows)
    for k in (1, 2, 57, 200, 360):
        assert smallest(df, "key", k) == ranked[k - 1]


def test_nearest_vectors_in_blocks(spark):
    from tessera.plans.curation import top_similar

    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in range(0, 60, 4):
        s = np.round(u @ u[q], 6)
        for rank, j in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (-s[j], j))[:4]):
            want.add((q, j, rank + 1))
    for block in (1 << 20, 100):
        got = top_similar(df, "id", "v", df.filter(F.col("id") % 4 == 0), 4, block_bytes=block).collect()
        assert {(r["q_id"], r["id"], r["rank"]) for r in got} == want

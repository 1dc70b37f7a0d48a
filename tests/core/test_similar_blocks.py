"""Scores of a block of queries are never all there at once."""

import numpy as np


def test_few_scores_at_a_time(spark, monkeypatch):
    import inspect

    from tessera.plans import curation

    assert "SCORES" in inspect.getsource(curation.top_similar)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (120, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    score = np.round(unit @ unit.T, 6)
    want = [(q, i) for q in range(0, 120, 3) for i in sorted((j for j in range(120) if j != q), key=lambda j: (-score[q, j], j))[:5]]
    for scores in (1 << 18, 50):
        monkeypatch.setattr(curation, "SCORES", scores)
        got = curation.top_similar(df, "k", "v", df.filter("k % 3 = 0"), 5)
        assert sorted((r["q_id"], r["k"]) for r in got.collect()) == sorted(want)

"""The bootstrap by sets and patterns: what plain draws give, in memory that does not grow with draws."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import validation as V


def plain(values, votes, k):
    """best, worst and majority of every draw of one prompt."""
    draws = M._draws(len(values), k)
    first = [max(range(k), key=lambda i, d=d: (sum(votes[d] == votes[d[i]]), -i)) for d in draws]
    return values[draws].max(1), values[draws].min(1), values[draws[np.arange(len(draws)), first]]


def test_draws_are_counted_by_set_and_pattern():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 8, 10, 11, 13):  # the last two beyond FEW
        values, votes = rng.integers(1, 50, (4, n)).astype(float), rng.integers(0, 3, (4, n))
        got = M.prompt_metrics(values, votes)
        for k in M.subset_sizes(n):
            for i in range(4):
                for kind, x in zip(("best", "worst", "maj"), plain(values[i], votes[i], k), strict=True):
                    assert np.isclose(got[f"{kind}@{k}/mean"][i], x.mean()) and np.isclose(got[f"{kind}@{k}/std"][i], x.std())
    many = rng.random((4000, 4)), rng.integers(0, 3, (4000, 4))
    M.prompt_metrics(*many)
    tracemalloc.start()
    M.prompt_metrics(*many)
    assert tracemalloc.get_traced_memory()[1] < 32e6  # 4,000 prompts by 1,000 draws of four are 128 MB
    tracemalloc.stop()


def test_patterns_and_null_sources(spark):
    assert M.first_equal(np.array([[7, 3, 7, 3, 1], [2, 2, 2, 2, 2]])).tolist() == [[0, 1, 0, 1, 4], [0, 0, 0, 0, 0]]
    rows = [(None, 1, 0, 2.0, "a"), (None, 1, 1, 4.0, None), ("s", 2, 0, 5.0, "a"), ("s", 3, 0, None, "b"), ("s", 3, 1, 1.0, "b")]
    df = spark.createDataFrame(rows, "src string, uid int, o int, v double, p string")
    got = {(r["source"], r["metric"]): (r["value"], r["prompts"]) for r in M.validation_metrics(df, "src", "uid", "v", "o", "p").collect()}
    assert got["", "mean@2"] == (3.0, 1) and got["s", "mean@1"] == (5.0, 1) and np.isnan(got["s", "best@2/mean"][0])
    assert {m for s, m in got if s == ""} == {"mean@2", "std@2"} | {f"{k}@2/{x}" for k in ("best", "worst", "maj") for x in ("mean", "std")}
    assert M.validation_metrics(df.filter(F.lit(False)), "src", "uid", "v", "o").count() == 0


def test_laws_of_votes_are_worked_out_once_a_pattern(monkeypatch):
    calls = []
    law = V.win_probabilities
    monkeypatch.setattr(V, "win_probabilities", lambda *a: calls.append(a) or law(*a))
    rng = np.random.default_rng(4)
    values, votes = rng.random((5000, 4)), rng.integers(0, 3, (5000, 4))
    got = V.exact_prompt_metrics(values, votes)
    assert 0 < len(calls) <= 2 * 14  # 14 patterns of four votes of three kinds, for k of 2 and 4
    for i in range(9):
        one = V.exact_prompt_metrics(values[i : i + 1], votes[i : i + 1])
        assert all(np.isclose(got[k][i], one[k][0]) for k in got)

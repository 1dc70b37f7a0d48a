"""Masked aggregates, folds and group estimators against goldens and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import advantages as A
from tessera.operators import metrics as M
from tessera.operators import tokens as T

NAN = float("nan")


def test_masked_mean_goldens(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1]), (1, [1.0, NAN, 3.0, 4.0], [1, 0, 0, 1]), (2, [1.0, NAN, 3.0, 4.0], [1, 1, 0, 1])], "k int, v array<double>, response_mask array<int>")
    got = [r["m"] for r in df.select("k", T.masked_mean("v").alias("m")).orderBy("k").collect()]
    assert got[0] == pytest.approx(2.5) and got[1] == pytest.approx(2.5) and math.isnan(got[2])


def test_masked_var_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1, 0])], "v array<double>, response_mask array<int>")
    with pytest.raises(Exception, match="fewer than two"):
        T.masked_stats(df, "v").collect()


def test_gae_ignores_masked_values(spark):
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rewards = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    rng = np.random.default_rng(0)
    base = rng.random(11)
    rows = [(i, rewards, [float(b if m else rng.random()) for b, m in zip(base, mask)], mask) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, r array<double>, v array<double>, response_mask array<int>")
    got = [r["a"] for r in df.select(T.gae("r", "v", gamma=0.9, lam=0.8).alias("a")).collect()]
    nxt = last = 0.0
    want = []
    for t in reversed(range(11)):
        if mask[t]:
            last = rewards[t] + 0.9 * nxt - base[t] + 0.72 * last
            nxt = base[t]
        want.append(last)
    for g in got:
        assert np.allclose(g, want[::-1])


def test_group_goldens(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g int, s double")
    got = {r["g"]: (r["mean"], r["std"], r["n"]) for r in M.group_mean_std(df, "s", "g").collect()}
    assert got[0] == pytest.approx((2, math.sqrt(2), 2)) and got[1] == (0, 1, 1)
    assert M.group_mean_std(df.limit(0), "s", "g").collect() == []


def test_singletons_differ(spark):
    df = spark.createDataFrame([(0, "a", 3.0, 1)], "row_id long, uid string, score double, length int")
    one = lambda name: A.advantages(df, name).first()["advantage"]
    assert one("rloo") == 3 and one("rloo_vectorized") == 0 and one("grpo") == pytest.approx(3) and one("opo") == 3
    with pytest.raises(Exception, match="two rollouts"):
        one("grpo_passk")


def test_registry_refuses_doubles():
    with pytest.raises(ValueError):
        A.estimator("grpo")(lambda b: b.s)
    with pytest.raises(ValueError):
        A.get_estimator("GRPO")


def test_loop_and_vectorized_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"g{i % 7}", float(rng.random()), int(rng.integers(1, 9))) for i in range(70)]
    df = spark.createDataFrame(rows, "row_id long, uid string, score double, length int")
    for a, b in (("rloo", "rloo_vectorized"), ("grpo", "grpo_vectorized")):
        x = A.advantages(A.advantages(df, a, out="x"), b, out="y").collect()
        assert np.allclose([r["x"] for r in x], [r["y"] for r in x], rtol=1e-5)


def test_pair_preference(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0), (3, 5.0)], "row_id long, score double")
    assert [r["preferred"] for r in A.pair_preference(df, A.Batch()).orderBy("row_id").collect()] == [True, False, False, True]
    with pytest.raises(Exception, match="even number"):
        A.pair_preference(df.limit(3), A.Batch()).collect()


def test_majority_goldens(spark):
    df = spark.createDataFrame([("p", i, v, x) for i, (v, x) in enumerate([("A", 0.9), ("B", 0.8), ("A", 0.7)])] + [("q", i, v, x) for i, (v, x) in enumerate([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)])], "g string, o int, vote string, v double")
    assert {r["g"]: r["v"] for r in M.majority_value(df, "g", "vote", "v", "o").collect()} == {"p": 0.9, "q": 0.9}


def test_bootstrap_equals_plain_numpy():
    values, votes = np.array([0.1, 0.9, 0.4, 0.4, 0.7]), ["a", "b", "b", "c", "a"]
    got = M.prompt_metrics(values[None], np.array([[0, 1, 1, 2, 0]]))
    for k in (2, 4, 5):
        np.random.seed(42)
        best, maj = [], []
        for _ in range(1000):
            i = np.random.choice(5, size=k, replace=True)
            best.append(values[i].max())
            seen = {}
            for j in i:
                seen.setdefault(votes[j], []).append(values[j])
            maj.append(seen[max(seen, key=lambda v: len(seen[v]))][0])
        assert got[f"best@{k}/mean"][0] == pytest.approx(np.mean(best)) and got[f"best@{k}/std"][0] == pytest.approx(np.std(best))
        assert got[f"maj@{k}/mean"][0] == pytest.approx(np.mean(maj))
    assert M.subset_sizes(1) == [] and M.subset_sizes(8) == [2, 4, 8] and M.subset_sizes(9) == [2, 4, 8, 9]


def test_rollup_rules(spark):
    df = spark.createDataFrame([("x/weighted_avg", 1.0, 0), ("x/weighted_avg", 3.0, 1), ("training/global_step", 1.0, 0), ("training/global_step", 2.0, 1), ("timing_s/gen", 1.0, 0), ("timing_s/gen", 2.0, 1)], "key string, value double, step int")
    got = {r["key"]: r["value"] for r in M.rollup(df, []).collect()}
    assert got == {"x/weighted_avg": 2.0, "training/global_step": 2.0, "timing_s/gen": 3.0}


def test_adaptive_kl():
    c = T.kl_controller("adaptive", 1.0, 0.1, 100)
    assert c.update(0.2, 100) == pytest.approx(1.2)
    with pytest.raises(ValueError):
        T.AdaptiveKL(1, 1, 0)


def test_eos_mask_golden(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0],), ([5, 6],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(T.eos_mask("ids", [1])).collect()] == [[1, 1, 1, 1, 0, 0], [1, 1], []]


def test_overlong_penalty(spark):
    assert spark.range(1).select(T.overlong_penalty(F.lit(90), 100, 20)).first()[0] == pytest.approx(-0.5)


def test_weights_are_capped_and_shared(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=10).tolist(), rng.normal(size=10).tolist(), [1] * 10) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, old_log_prob array<double>, ref_log_prob array<double>, response_mask array<int>")
    for r in T.importance_weights(df, "sequence", 2.0).collect():
        assert len(set(r["rollout_is_weights"])) == 1 and max(r["rollout_is_weights"]) <= 2
    for r in T.importance_weights(df, "token", 2.0).collect():
        assert max(r["rollout_is_weights"]) <= 2

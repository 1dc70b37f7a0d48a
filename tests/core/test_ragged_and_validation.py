"""Ragged structs, batches by schema, scatter to masks, and the exact laws against draws and enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ragged as R
from tessera.operators import validation as V
from tessera.operators.metrics import prompt_metrics


def test_ragged_round_trips_slices_and_unions(spark):
    lists = [[[1, 2], [], [3]], [], [[]], [None, [4]], [[5] * 40]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<array<long>>").withColumn("r", R.checked(R.ragged(F.col("x"))))
    want = {i: [y or [] for y in x] for i, x in enumerate(lists)}
    assert {r["i"]: r["b"] for r in df.select("i", R.rows_of(F.col("r")).alias("b")).collect()} == want
    for lo, hi in ((0, 1), (1, 3), (2, 99), (5, 9), (3, 1)):
        got = df.select("i", R.rows_of(R.checked(R.sliced(F.col("r"), lo, hi))).alias("b")).collect()
        assert {r["i"]: r["b"] for r in got} == {i: x[lo:hi] for i, x in want.items()}
    twice = df.select("i", R.concatenated([F.col("r"), F.when(F.col("i") != 0, F.col("r")), F.col("r")]).alias("r"))
    got = twice.select("i", R.rows_of(R.checked(F.col("r"))).alias("b")).collect()
    assert {r["i"]: r["b"] for r in got} == {i: x * (3 if i else 2) for i, x in want.items()}
    all_ = R.gathered(df.withColumn("g", F.lit(1)), "g", "i", "r").select(R.rows_of(F.col("r"))).first()[0]
    assert all_ == [y for i in range(5) for y in want[i]]


@pytest.mark.parametrize("offsets", [[], [1, 2], [0, 2, 1, 3], [0, 2]])
def test_offsets_that_fit_nothing_raise(spark, offsets):
    df = spark.createDataFrame([(([1, 2, 3], offsets),)], "r struct<values: array<long>, offsets: array<long>>")
    with pytest.raises(Exception, match="offsets do not fit"):
        df.select(R.checked(F.col("r"))).collect()


def test_trajectories(spark):
    rows = [(2, [10, 11], [[1], [2]], "a"), (1, [], [], "b"), (3, [12], [[3]], None)]
    df = spark.createDataFrame(rows, "k int, action array<int>, state array<array<int>>, who string")
    got = [tuple(r) for r in R.flatten_trajectories(df, "k", "action").select("row_id", "k", "action", "state", "who", "step").orderBy("row_id").collect()]
    assert got == [(0, 2, 10, [1], "a", 1), (1, 2, 11, [2], "a", 2), (2, 3, 12, [3], None, 1)]
    bad = spark.createDataFrame([(1, [1, 2], [3])], "k int, action array<int>, other array<int>")
    with pytest.raises(Exception, match="other has not a value a step"):
        R.flatten_trajectories(bad, "k", "action").collect()


def test_batches_by_schema(spark):
    df = spark.createDataFrame([(1, [1.5], "x", 7), (2, None, None, 7)], "row int, t array<double>, s string, temp int")
    tensors, others, meta = R.split_batch(df, "row", ["temp"])
    assert (tensors.columns, others.columns, meta) == (["row", "t"], ["row", "s"], {"temp": 7})
    assert sorted(R.joined_batch(tensors, others, meta, "row").collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="differ between rows"):
        R.split_batch(df.withColumn("temp", F.col("row")), "row", ["temp"])
    with pytest.raises(ValueError, match="more than one side"):
        R.joined_batch(tensors, others.withColumnRenamed("s", "t"), {}, "row")


def test_scatter(spark):
    rows = [([0, 1, 1, 0], [[1.0, 2.0], [3.0, 4.0]]), ([0, 0], []), ([], []), (None, [[1.0, 1.0]]), ([1, 0, 1], [[5.0, 6.0]]), ([1], [[7.0, 8.0], [9.0, 9.0]]), ([1, 1], None), ([1], [None])]
    df = spark.createDataFrame(rows, "mask array<int>, v array<array<double>>").coalesce(1)
    z = [0.0, 0.0]
    got = [r[0] for r in df.select(R.scattered_to_mask(F.col("v"), F.col("mask"), 2, strict=False)).collect()]
    assert got == [[z, [1.0, 2.0], [3.0, 4.0], z], [z, z], [], None, [[5.0, 6.0], z, z], [[7.0, 8.0]], [z, z], [z]]
    with pytest.raises(Exception, match="not as many values"):
        df.select(R.scattered_to_mask(F.col("v"), F.col("mask"), 2)).collect()
    with pytest.raises(Exception, match="has not 3 numbers"):
        df.select(R.scattered_to_mask(F.col("v"), F.col("mask"), 3, strict=False)).collect()


def enumerated(values, votes, k):
    """Mean and deviation of best, worst and majority over all n^k draws."""
    out = {"best": [], "worst": [], "maj": []}
    for draw in itertools.product(range(len(values)), repeat=k):
        x = [values[i] for i in draw]
        v = [votes[i] for i in draw]
        first = max(dict.fromkeys(v), key=v.count)
        out["best"].append(max(x))
        out["worst"].append(min(x))
        out["maj"].append(x[v.index(first)])
    return {kind: (np.mean(x), np.std(x)) for kind, x in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_exact_laws_are_those_of_all_draws(seed):
    rng = np.random.default_rng(seed)
    n = 5
    values, votes = rng.integers(0, 4, (3, n)).astype(float), rng.integers(0, 3, (3, n))
    votes = np.stack([np.unique(v, return_inverse=True)[1] for v in votes])
    got = V.exact_prompt_metrics(values, votes)
    assert set(got) == {"mean@5", "std@5", *(f"{a}@{k}/{b}" for a in ("best", "worst", "maj") for b in ("mean", "std") for k in (2, 4, 5))}
    for row in range(3):
        for k in (2, 4, 5):
            for kind, (mean, std) in enumerated(values[row], votes[row].tolist(), k).items():
                assert got[f"{kind}@{k}/mean"][row] == pytest.approx(mean) and got[f"{kind}@{k}/std"][row] == pytest.approx(std, abs=1e-6)


def test_draws_are_within_their_error_of_the_exact_laws():
    rng = np.random.default_rng(9)
    values, votes = rng.normal(size=(20, 16)), np.stack([np.unique(v, return_inverse=True)[1] for v in rng.integers(0, 5, (20, 16))])
    drawn, exact = prompt_metrics(values, votes), V.exact_prompt_metrics(values, votes)
    assert set(drawn) == set(exact)
    for name in drawn:
        if name.endswith("/mean"):
            error = exact[name.replace("/mean", "/std")] / np.sqrt(1000)
            assert (np.abs(drawn[name] - exact[name]) <= 5 * error + 1e-12).all(), name


def test_win_probabilities_sum_to_one():
    for counts in ((1,), (1, 1), (3, 1, 2), (1,) * 12, (7, 5, 3, 1)):
        for k in (1, 2, 5, 16):
            p = V.win_probabilities(counts, k)
            assert sum(p) == pytest.approx(1) and (len(set(counts)) > 1 or len({round(x, 9) for x in p}) == 1)


def test_validated_names(spark):
    df = spark.createDataFrame([(1, "m", ["a", "b"], 3), (2, "m", ["a"], 5), (3, None, ["b", "b"], 1)], "uid int, src string, said array<string>, turns int")
    got = {r["name"]: r["value"] for r in V.validated(df, uid="uid", source="src", responses="said", score=(F.col("response") == "a").cast("double"), turns="turns").collect()}
    assert got["val-core/m/reward/best@2/mean"] == pytest.approx(0.75) and got["val-aux/m/reward/mean@1"] == 1.0 and got["val-core//reward/mean@2"] == 0.0
    assert (got["val-aux/num_turns/min"], got["val-aux/num_turns/max"], got["val-aux/num_turns/mean"]) == (1.0, 5.0, pytest.approx(2.6))
    assert not any("maj@" in k for k in got)
    assert V.exact_validation_metrics(df.withColumn("v", F.lit(None).cast("double")), "src", "uid", "v").count() == 0

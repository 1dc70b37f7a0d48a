"""Errors, empty tables and restarts of batches, quotas, dispatch, tools, queues and rollout correction."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import tokens as T
from tessera.operators.frame import ROW, SampleFrame


def rollouts(spark, rows):
    return spark.createDataFrame(rows, f"{T.OLD} array<double>, {T.REF} array<double>, {T.MASK} array<int>, {T.NEW} array<double>, {T.ADV} array<double>")


def test_correction_by_hand(spark):
    t = rollouts(spark, [([-1.0, -1.0], [-1.0, -3.0], [1, 1], [-1.0, -1.0], [1.0, 2.0]), ([-1.0, -9.0], [-1.0, -1.0], [1, 1], [-1.0, -1.0], [1.0, 1.0]), ([0.0, 0.0], [5.0, 5.0], [0, 0], [0.0, 0.0], [1.0, 1.0])])
    m = T.correction_metrics(t, weights="token", threshold=2.0, reject="token", upper=2.0, veto=1e-3).first()
    assert m["rollout_is_veto_fraction"] == pytest.approx(1 / 3) and m["rollout_is_catastrophic_token_fraction"] == pytest.approx(1 / 4, abs=1e-6)
    assert m["rollout_rs_masked_fraction"] == pytest.approx(2 / 4, abs=1e-6) and m["rollout_rs_seq_masked_fraction"] == pytest.approx(2 / 3)
    kept = [r[T.MASK] for r in T.corrected(t, weights="token", reject="token", upper=2.0, veto=1e-3).collect()]
    assert kept == [[1, 0], [0, 0], [0, 0]]
    w = [r["rollout_is_weights"] for r in T.corrected(t, weights="sequence", threshold=2.0).collect()]
    assert w[0] == [2.0, 2.0] and w[2] == [0.0, 0.0]
    with pytest.raises(Exception, match="no token"):
        T.correction_metrics(t.filter(F.col(T.MASK)[0] == 0)).collect()
    with pytest.raises(ValueError):
        T.corrected(t, reject="token")
    with pytest.raises(ValueError):
        T.bypassed(t.drop(T.REF))


def test_batch_of_aborted_rows_raises(spark):
    from tessera.operators.metrics import batch_metrics

    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "s double, n int")
    with pytest.raises(Exception, match="aborted"):
        batch_metrics(df, "s", "s", "n", "n", 3, 3).collect()


def test_micro_batches(spark):
    from tessera.operators.balance import differencing, token_batches, zigzag

    assert zigzag(range(5), [5, 4, 3, 2, 1]) == [4, 2, 0, 1, 3]
    rows = [(0, i, 10) for i in range(8)] + [(1, i, 30) for i in range(8, 12)]
    df = spark.createDataFrame(rows, "b long, r long, n long")
    got = token_batches(df.withColumn("s", F.lit(1)), "b", "r", "n", 40, step="s").groupBy("batch").agg(F.count_distinct("micro_batch").alias("k")).collect()
    assert {r["batch"]: r["k"] for r in got} == {0: 3, 1: 3}
    for bad in ({"budget": 20}, {"budget": 40, "multiple": 9}):
        with pytest.raises(Exception, match="exceeds|don't make"):
            token_batches(df, "b", "r", "n", **bad).collect()
    assert sorted(sum(differencing([5, 1, 4, 2, 8], 2), [])) == [0, 1, 2, 3, 4]


def test_quota_and_dispatch(spark):
    from tessera.operators import dispatch
    from tessera.plans.rows import until_quota

    df = spark.range(40).select("id", (F.col("id") % 10).alias("k"))
    batches = [df.filter(F.expr(f"id div 10 = {i}")) for i in range(4)]
    got = until_quota(iter(batches), lambda b: b.filter("id % 3 = 0"), "k", ["id"], 5, 3).collect()
    assert {r["k"] for r in got} == {0, 3, 6, 9, 2}
    with pytest.raises(ValueError):
        until_quota(iter(batches), lambda b: b.limit(0), "k", ["id"], 5, 2)
    with pytest.raises(ValueError):
        dispatch.register_mode("dp_compute", dispatch.get_mode("dp_compute"))
    with pytest.raises(ValueError):
        dispatch.get_mode("nowhere")
    f = SampleFrame(df.limit(0).withColumn(ROW, F.lit(0).cast("long")))
    assert dispatch.dispatched(f, "dp_compute", 3, lambda d: d).collect() == []


def test_queue_restarts_and_forgets(spark, monkeypatch):
    from tessera.streaming.samples import BoundedQueue

    monkeypatch.setattr(BoundedQueue, "BLOCK", 10)
    q = BoundedQueue(spark, 25, "v long")
    rows = spark.range(100).select(F.col("id").alias("v"))
    assert not q.put(rows, ["v"]) and len(q) == 25 and q.dropped == 75
    assert sorted(r["v"] for r in q.get(5).collect()) == list(range(75, 80))
    again = BoundedQueue(spark, 25, "v long", path=q.path)
    assert again.statistics() == q.statistics()
    assert again.put(spark.range(3).select(F.col("id").alias("v")), ["v"])
    assert [r["v"] for r in again.get(100).orderBy("_seq").collect()] == [*range(80, 100), 0, 1, 2]
    assert again.get(5).collect() == [] and again.memory()["bytes"] > 0
    again.clear()
    assert len(BoundedQueue(spark, 25, "v long", path=q.path)) == 0


def test_agents(spark):
    from tessera.plans import agents

    assert agents.within(5, lambda x: x + 1, 2) == 3
    with pytest.raises(TimeoutError):
        agents.within(0.05, __import__("time").sleep, 2)
    with pytest.raises(ZeroDivisionError):
        agents.within(5, lambda: 1 / 0)
    with pytest.raises(ValueError):
        agents.register(agents.PARSERS, "hermes")(lambda t: t)
    with pytest.raises(ValueError):
        agents.find(agents.TOOLS, "none")
    assert [d for d in agents.one_ahead([lambda i=i: i for i in range(4)])] == [0, 1, 2, 3] and list(agents.one_ahead([])) == []
    assert agents.run_tools(spark.createDataFrame([], "t long, o long, n string, a string"), "t", "o", "n", "a").collect() == []


def test_written_tables_drop_their_shuffles_and_keep_the_settings(spark):
    from tessera.session import ARROW_ROWS, freed, written

    before = spark.conf.get(ARROW_ROWS)
    with pytest.raises(ValueError), freed(spark):
        assert spark.conf.get(ARROW_ROWS) == "1000"
        raise ValueError
    assert spark.conf.get(ARROW_ROWS) == before
    assert written(spark.range(1000).repartition(20), "few").count() == 1000

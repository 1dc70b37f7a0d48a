"""Tools and generators as table functions: order, one instance a key, errors, nulls, empty tables; balancing by blocks."""

import numpy as np
import pytest

from tessera.operators import balance
from tessera.plans import agents


def counter():
    """A tool's class, made here so that it travels by value."""

    class Count(agents.Tool):
        def create(self, trajectory):
            self.of, self.n = trajectory, 0

        def execute(self, arguments):
            self.n += arguments["by"]
            return f"{self.of}:{self.n}", 0.5

        def reward(self):
            return float(self.n)

    return Count


def test_a_tool_has_one_instance_a_trajectory(spark, monkeypatch):
    monkeypatch.setitem(agents.TOOLS, "count", counter())
    calls = [(t, o, "count", f'{{"by": {o}}}') for o in range(5) for t in (1, 2, None)] + [(1, 9, "none", "{}"), (2, 9, "count", "no json"), (2, 10, "count", None), (2, 11, "count", '{"by": 100}')]
    df = spark.createDataFrame(calls, "t long, o long, n string, a string").repartition(4)
    got = sorted(((r["trajectory"] or 0, r["ord"], r["response"], r["step_reward"], r["tool_reward"]) for r in agents.run_tools(df, "t", "o", "n", "a").collect()))
    sums = {o: sum(range(o + 1)) for o in range(5)}
    want = [(t or 0, o, f"{t}:{sums[o]}", 0.5, float(sums[o])) for t in (1, 2, None) for o in range(5)]
    want += [(1, 9, "error: KeyError", 0.0, 0.0), (2, 9, "error: JSONDecodeError", 0.0, 0.0), (2, 10, "error: TypeError", 0.0, 0.0), (2, 11, "2:110", 0.5, 110.0)]
    assert got == sorted(want)


def pairs():
    """A generator's class: each row with the one before, and the number of rows at the end."""

    class Pairs(agents.Generator):
        def start(self, key):
            self.key, self.before, self.n = key, None, 0

        def row(self, row):
            if self.before is not None:
                yield self.key, self.before, row["v"]
            self.before, self.n = row["v"], self.n + 1

        def end(self):
            yield self.key, -1, self.n

    return Pairs


def test_generators_see_rows_in_order(spark):
    rows = [(k, v, "x") for v in (3, 1, 2) for k in ("a", None)] + [("b", 7, None)]
    df = spark.createDataFrame(rows, "k string, v int, other string").repartition(3)
    got = agents.generated_table(df, pairs(), "k string, a int, b int", "k", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, *p) for k in ("a", None) for p in ((1, 2), (2, 3), (-1, 3))] + [("b", -1, 1)], key=str)
    assert agents.generated_table(df.limit(0), pairs(), "k string, a int, b int", "k", "v").collect() == []
    with pytest.raises(Exception, match="has no"):
        agents.generated_table(df, pairs(), "k string, a int, b int", "nothing", "v")


def test_appended_rows_come_behind(spark):
    df = spark.createDataFrame([(2, "x"), (1, "y")], "v int, s string")
    got = agents.appended(df, spark.createDataFrame([(0,)], "v int"), ["v"]).orderBy("row_id").collect()
    assert [(r["row_id"], r["v"], r["s"]) for r in got] == [(0, 1, "y"), (1, 2, "x"), (2, 0, None)]


def test_batches_that_cross_arrow_batches(spark):
    """Blocks are cut by batches only, whatever Arrow hands over at once."""
    rng = np.random.default_rng(1)
    rows = [(b, r, int(rng.integers(1, 50))) for b in range(7) for r in range(int(rng.integers(4, 40)))]
    df = spark.createDataFrame(rows, "b long, r long, n long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        small = sorted(map(tuple, balance.balanced(df, "b", "r", "n", 4, equal_size=False).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert small == sorted(map(tuple, balance.balanced(df, "b", "r", "n", 4, equal_size=False).collect()))
    assert sorted(x[:2] for x in small) == sorted(x[:2] for x in rows)
    assert balance.balanced(df.limit(0), "b", "r", "n", 4).collect() == []

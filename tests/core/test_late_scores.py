"""Late rows wait side by side, and never cost another row its score."""

import time

from tessera.functions.rewards import get_manager


def test_late_rows_wait_side_by_side(spark):
    def score(row: dict) -> float:
        if row["i"] % 25 == 3:
            time.sleep(4.0 if row["i"] % 2 else 0.4)
        if row["i"] % 10 == 4:
            raise RuntimeError("no score")
        return row["i"] + 0.5

    df = spark.range(1000).selectExpr("cast(id as int) as i", "2 as n").coalesce(1)
    began = time.time()
    got = {r["i"]: r["score"] for r in get_manager("prime")(df, score, "n", 3, timeout=2.0).select("i", "score").collect()}
    # twenty rows are late and twenty only slow: one after another they would take 40 seconds
    assert time.time() - began < 20
    assert got == {i: 0.0 if i % 10 == 4 or (i % 25 == 3 and i % 2) else i + 0.5 for i in range(1000)}


def test_scorers_that_compute_keep_their_time(spark):
    def score(row: dict) -> float:
        end = time.thread_time() + 0.03
        while time.thread_time() < end:
            pass
        return 1.0

    df = spark.range(60).selectExpr("cast(id as int) as i", "2 as n").coalesce(1)
    assert {r["score"] for r in get_manager("prime")(df, score, "n", 3, timeout=1.5).collect()} == {1.0}

"""BLEU by tasks of bounded text, with and without rows whose grams are dealt out."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import conversations as C


def plain(c: str, r: str) -> float:
    if not set(c) & set(r):
        return 0.0
    log = 0.0
    for k in range(1, 5):
        a, b = (Counter(t[i : i + k] for i in range(len(t) - k + 1)) for t in (c, r))
        log += math.log((sum((a & b).values()) or C.TINY) / max(len(c) - k + 1, 1)) / 4
    return math.exp(log) * (1 if len(c) > len(r) else math.exp(1 - len(r) / len(c)))


def test_tasks_are_many_and_long_rows_dealt_out(spark, monkeypatch):
    pairs = [("the cat sat", "the cat is on the mat"), ("abc", "abd"), ("a", "a"), ("", "x"), ("x", ""), ("aaaa", "aa"), ("the quick brown fox " * 9, "the quick red fox " * 8)]
    df = spark.createDataFrame([(i, c or None, r) for i, (c, r) in enumerate(pairs)], "i int, c string, r string")
    monkeypatch.setattr(C, "TASK_CHARS", 32, raising=False)
    for long in (100, 1 << 20):
        monkeypatch.setattr(C, "LONG", long, raising=False)
        got = {r["i"]: r["bleu"] for r in C.bleu(df, "i", "c", "r").collect()}
        assert all(math.isclose(got[i], plain(*p), rel_tol=1e-9, abs_tol=1e-300) for i, p in enumerate(pairs))
    few = df.filter(F.length("c") < 100)
    plan = C.bleu(few.unionByName(few.withColumn("i", F.col("i") + 10)), "i", "c", "r")._jdf.queryExecution().executedPlan().toString()
    assert "g#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "g#" in x.split("Exchange", 1)[1]]

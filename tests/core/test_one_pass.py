"""Texts of a pair are encoded in one pass: a task has one Python worker, not one a column."""

from tessera.plans import datasets as D


def test_pairs_are_encoded_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a bb", "ccc", None)], "k int, p string, c string, r string")
    s = D.stacked_pairs(df, "p", "c", "r", lambda texts: [[len(w) for w in t.split()] for t in texts], 5, end=9)
    assert [tuple(map(list, (r["input_ids"], r["attention_mask"]))) for r in s.collect()] == [([[1, 2, 3, 9, 0], [1, 2, 9, 0, 0]], [[1, 1, 1, 1, 0], [1, 1, 1, 0, 0]])]
    assert s._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1

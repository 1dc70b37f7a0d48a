"""Frames: goldens of order, repetition, padding, folding and merging."""

import pytest

from tessera.operators.frame import ROW, SampleFrame, with_row_id


@pytest.fixture
def frame(spark):
    df = spark.createDataFrame([(0, [1, 2], "a"), (1, [3, 4], "b"), (2, [5, 6], "c")], "row_id long, obs array<int>, labels string")
    return SampleFrame(df, {"name": "x"})


def labels(f):
    return [r["labels"] for r in f.df.orderBy(ROW).collect()]


def ids(f):
    return [r[ROW] for r in f.df.orderBy(ROW).collect()]


def test_repeat(frame):
    assert labels(frame.repeat(2)) == list("aabbcc")
    assert labels(frame.repeat(2, interleave=False)) == list("abcabc")
    assert ids(frame.repeat(2, interleave=False)) == list(range(6))


def test_repeat_each(frame, spark):
    from pyspark.sql import functions as F

    counts = F.when(F.col("labels") == "a", 3).when(F.col("labels") == "b", 1).otherwise(2)
    assert labels(frame.repeat_each(counts)) == list("aaabcc")
    assert labels(frame.repeat_each(F.when(F.col("labels") == "b", 2).otherwise(0))) == list("bb")


@pytest.mark.parametrize(("divisor", "want", "pad"), [(2, "abca", 1), (3, "abc", 0), (7, "abcabca", 4)])
def test_pad_to_divisor(frame, divisor, want, pad):
    padded, n = frame.pad_to_divisor(divisor)
    assert labels(padded) == list(want) and n == pad
    assert labels(padded.unpad(n)) == list("abc")


def test_fold_and_reorder(frame, spark):
    folded = frame.repeat(2).fold(3)
    turned = folded.reorder(spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old long, new long"))
    assert labels(turned.unfold(2)) == list("bbccaa")


def test_unfold_columns(frame):
    out = frame.unfold_columns(2, ["obs"]).df.orderBy(ROW).collect()
    assert [r["obs"] for r in out] == [[1], [2], [3], [4], [5], [6]] and [r["labels"] for r in out] == list("aabbcc")


def test_slices_and_gathers(frame):
    assert labels(frame.slice(None, None, -1)) == list("cba")
    assert labels(frame.slice(1, 9)) == list("bc") and ids(frame.slice(1, 9)) == [0, 1]
    assert labels(frame.take([2, -3, 2])) == list("cac")
    assert labels(frame.pad(2)) == list("abccc") and labels(frame.pad(1, first=True)) == list("abca")
    assert [labels(c) for c in frame.chunk(2, padded=True)] == [list("ab"), list("c")]
    with pytest.raises(ValueError):
        frame.chunk(2)


def test_union_of_columns(frame, spark):
    same = SampleFrame(frame.df.select(ROW, "labels", frame.df.obs.alias("more")))
    assert set(frame.union_columns(same).columns) == {"obs", "labels", "more"}
    other = SampleFrame(spark.createDataFrame([(0, "a"), (1, "x"), (2, "c")], "row_id long, labels string"))
    with pytest.raises(Exception, match="frames differ"):  # the check is part of the plan
        frame.union_columns(other).count()
    nan = spark.createDataFrame([(0, float("nan")), (1, None)], "row_id long, v double")
    assert SampleFrame(nan).union_columns(SampleFrame(nan)).count() == 2


def test_concat_meta(frame):
    a, b = SampleFrame(frame.df, {"metrics": [1], "k": 1}), SampleFrame(frame.df, {"metrics": [2], "k": 1})
    both = SampleFrame.concat([a, b])
    assert both.meta == {"metrics": [1, 2], "k": 1} and labels(both) == list("abcabc")
    with pytest.raises(ValueError):
        SampleFrame.concat([a, SampleFrame(frame.df, {"k": 2})])


def test_row_ids_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (None, 0)], "k int, v int")
    assert [(r["k"], r[ROW]) for r in with_row_id(df, ["k", "v"]).orderBy(ROW).collect()] == [(None, 0), (None, 1), (3, 2), (5, 3)]
    assert with_row_id(df.limit(0), ["k"]).collect() == []
    assert frame_empty(spark).slice(0, 5).count() == 0


def frame_empty(spark):
    return SampleFrame(spark.createDataFrame([], "row_id long, v int"))


def test_row_ids_of_a_hot_first_key_come_from_many_ranges(spark):
    """Ninety of a hundred rows have one first key; nulls on any place come first; no range has most of the rows."""
    from datetime import date
    from decimal import Decimal

    from pyspark.sql import functions as F

    from tessera.operators.frame import with_row_id

    rows = [("hot" if i % 10 else None if i % 20 else f"k{i}", None if i % 7 == 0 else date(2024, 1, 1 + i % 28), Decimal(i) / 4, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b date, c decimal(10,2), i int").repartition(5)
    keys = ["a", "b", "c", "i"]
    want = sorted(rows, key=lambda r: [(x is not None, x) for x in r])
    done = with_row_id(df, keys, ranges=8)
    assert [tuple(r)[:4] for r in done.orderBy("row_id").collect()] == want
    assert [r["row_id"] for r in done.orderBy("row_id").collect()] == list(range(2000))
    plan = done._jdf.queryExecution().optimizedPlan()
    assert "_range" in plan.toString()
    sizes = [r["n"] for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 1500

"""The data source of steps: round trips, pruning, aborted writes, streams by commits."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.session import shared_path
from tessera.sources import steps

SCHEMA = "a long, t string, l array<double>, step long"


def frame(spark, n, mod):
    return spark.range(n).select(F.col("id").alias("a"), F.concat(F.lit("é \"x\"\n"), "id").alias("t"), F.array(F.col("id") / 4, F.lit(None).cast("double")).alias("l"), (F.col("id") % mod).alias("step"))


def local(path):
    return path.removeprefix("file://")


@pytest.mark.parametrize("mod", [1, 7, 200])
def test_round_trip(spark, mod):
    path, rows = shared_path(spark, "steps"), frame(spark, 500, mod)
    steps.write_steps(rows, path)
    assert sorted(steps.read_steps(spark, path, SCHEMA).collect()) == sorted(rows.collect())
    less = steps.read_steps(spark, path, "a long, other string, step long")  # one column fewer, one that no line has
    assert less.agg(F.sum("a"), F.count("other")).first()[:] == (sum(range(500)), 0)


def test_filters_choose_files(spark):
    path = shared_path(spark, "steps")
    steps.write_steps(frame(spark, 100, 10).repartition("step"), path)
    broken = [f for f in os.listdir(local(path)) if f.startswith(("0-", "9-"))]
    assert len(broken) == 2
    for f in broken:  # files that no filter wants are never opened
        os.remove(f"{local(path)}/{f}")
    got = steps.read_steps(spark, path, SCHEMA)
    assert got.filter("step > 0 AND step <= 8").count() == 80
    assert got.filter("step = 3 AND a > 50").count() == 5 and got.filter("step IN (1, 2)").count() == 20
    assert got.filter("step = 77").count() == 0


def test_failed_write_leaves_nothing(spark):
    path = shared_path(spark, "steps")
    steps.write_steps(frame(spark, 20, 2), path)
    before = sorted(os.listdir(local(path)))
    bad = frame(spark, 50, 3).withColumn("step", F.when(F.col("a") < 49, F.col("step"))).repartition(4)
    with pytest.raises(Exception, match="no step"):
        steps.write_steps(bad, path)
    assert sorted(os.listdir(local(path))) == before
    assert steps.read_steps(spark, path, SCHEMA).count() == 20


def test_empty_tables_and_wrong_calls(spark):
    path = shared_path(spark, "steps")
    assert steps.read_steps(spark, path, SCHEMA).count() == 0
    steps.write_steps(frame(spark, 0, 1), path)
    assert steps.read_steps(spark, path, SCHEMA).count() == 0
    with pytest.raises(Exception, match="no column step"):
        steps.write_steps(frame(spark, 3, 1).drop("step"), path)
    with pytest.raises(Exception, match="appended"):
        frame(spark, 3, 1).write.format("steps").mode("overwrite").save(path)


def test_stream_goes_on_behind_the_last_commit(spark):
    root, seen = shared_path(spark, "steps"), []
    for k in range(3):
        steps.write_steps(frame(spark, 10, 2).withColumn("a", F.col("a") + 10 * k), f"{root}/dump")
        stream = spark.readStream.format("steps").schema(SCHEMA).load(f"{root}/dump")
        stream.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r["a"] for r in df.collect()))).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(10 * k, 10 * k + 10)) for k in range(3)]

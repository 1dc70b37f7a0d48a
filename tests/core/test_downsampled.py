"""The rows that are kept are never all in one task."""


def test_kept_rows_stay_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from tessera.operators.advantages import Batch, filter_and_downsample

    rows = [(g, i, None if g == 3 else float(10 * g)) for g in range(200) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, i long, s double")
    out = filter_and_downsample(df, Batch(score="s", group="g", order=("i",)), 500, 900, 2.0)
    inside, none = [g for g in range(200) if 500 <= 10 * g <= 900 and g != 3], [3]
    ranked = [(g, i) for g in [*inside, *[g for g in range(200) if g not in inside and g not in none], *none] for i in range(5)]
    assert sorted((r["g"], r["i"]) for r in out.collect()) == sorted(ranked[:500])
    assert out.columns == df.columns
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and sum(sizes) == 500

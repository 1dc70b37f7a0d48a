"""A task reads many small files of steps."""


def test_small_files_share_a_task(spark, tmp_path):
    from tessera.sources import steps

    path = str(tmp_path / "dump")
    steps.write_steps(spark.range(0, 300).selectExpr("id as n", "id as step").repartition(2), path)
    reader = steps.StepReader(path, None)
    tasks = reader.partitions()
    assert sum(len(t.files) for t in tasks) == 300 and len(tasks) == 1
    back = steps.read_steps(spark, path, "n long, step long")
    assert sorted(map(tuple, back.collect())) == [(i, i) for i in range(300)]
    assert sorted(r["n"] for r in back.filter("step >= 290").collect()) == list(range(290, 300))
    assert [len(t.files) for t in steps._tasks([steps.StepFile(0, "a", 60_000), steps.StepFile(1, "b", 60_000), steps.StepFile(2, "c", 1)])] == [1, 2]

"""Many pieces of a frame are one plan."""


def test_pieces_are_one_scan(spark):
    from tessera.operators.frame import SampleFrame

    f = SampleFrame.of(spark.range(0, 1003).withColumnRenamed("id", "k"), ["k"])
    out = f.pieces(10)
    assert sorted(map(tuple, out.select("piece", "row_id", "k").collect())) == [(k // 10, k % 10, k) for k in range(1003)]
    assert out._jdf.queryExecution().logical().toString().count("Union") == 0
    parts = f.split(400)
    assert [sorted(map(tuple, p.df.select("row_id", "k").collect()))[-1] for p in parts] == [(399, 399), (399, 799), (202, 1002)]

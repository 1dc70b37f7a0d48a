"""Incomplete batches are dealt to partitions too."""


def test_every_order_has_a_partition(spark, tmp_path):
    from tessera.operators.balance import _balanced

    keys = [*range(1, 64), *range(64, 128), *range(128, 131)]  # 63, 64 and 3 orders
    spark.createDataFrame([(k, 37 * k) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = _balanced(spark, str(tmp_path)).collect()
    assert sorted(r["row"] for r in rows) == keys
    sizes = {}
    for r in rows:
        sizes[r["batch"], r["partition"]] = sizes.get((r["batch"], r["partition"]), 0) + 1
    assert [sizes[1, p] for p in range(8)] == [8] * 8
    assert {p for b, p in sizes if b == 0} == set(range(8)) and {p for b, p in sizes if b == 2} == {0, 1, 2}

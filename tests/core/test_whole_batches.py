"""A batch is whole in one task, also where the planner reads a join's side where it lies."""


def test_token_batches_of_a_small_join(spark):
    from pyspark.sql import functions as F

    from tessera.operators import balance

    li = spark.range(0, 60_000, 1, 40).select((F.xxhash64("id") % 15_000).alias("row"), F.col("id").alias("v"))
    tokens = li.groupBy("row").agg(F.sort_array(F.collect_list("v")).alias("tokens"))
    s = tokens.select(F.expr("row div 64").alias("batch"), "row", F.size("tokens").alias("length"))
    done = balance.token_batches(s, "batch", "row", "length", 64).collect()
    assert len(done) == tokens.count()
    cuts = {}
    for r in done:
        cuts.setdefault(r["batch"], set()).add(r["micro_batch"])
    want = {r["batch"]: r["k"] for r in s.groupBy("batch").agg(F.least(F.count("*"), F.ceil(F.sum("length") / 64)).alias("k")).collect()}
    assert {b: len(m) for b, m in cuts.items()} == want


def test_dealt_in_order_is_in_order(spark):
    from tessera.operators import balance

    rows = [(b, i, (7 * i + b) % 13 + 1) for b in range(9) for i in range(b + 1)]
    df = spark.createDataFrame(rows, "b long, r long, n long")
    got = {(r["batch"], r["row"]): (r["partition"], r["length"]) for r in balance.dealt_in_order(df, "b", "r", "n", 4).collect()}
    want = {}
    for b in range(9):
        lengths = [n for k, _, n in rows if k == b]
        want |= {(b, i): (p, lengths[i]) for p, part in enumerate(balance.in_order(lengths, 4)) for i in part}
    assert got == want

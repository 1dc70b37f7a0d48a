"""Registered queries of frames: columns, schema and invariants, layouts and their inverses, over all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .frame import _O, ROW, SampleFrame, _orders
from .token_queries import token_table


def p02_pop_and_union(spark, sf_dir):
    """A column popped, renamed and merged back under its new name."""
    popped, rest = _orders(spark, sf_dir).pop(["o_custkey"])
    return rest.union_columns(popped.rename(["o_custkey"], ["customer"])).df.select(ROW, "o_orderkey", "customer")


def p09_get_and_assign(spark, sf_dir):
    """A column that is there, the default of one that is not, and new ones of an expression and of a constant."""
    o = _orders(spark, sf_dir)
    f = o.assign(there=o.get("o_custkey"), missing=o.get("weight", 1.5), kind="x", double_price=F.round(F.col("o_totalprice") * 2, 2))
    return f.select(["there", "missing", "kind", "double_price"]).df


def p05_info(spark, sf_dir):
    info = _orders(spark, sf_dir).info()
    return spark.createDataFrame(sorted(info.items()), "column string, type string")


def p06_sizes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    f = SampleFrame.of(o.select("o_orderkey", "o_orderpriority", F.split("o_orderpriority", "-").alias("parts"), F.transform(F.sequence(F.lit(0), F.col("o_custkey") % 3), lambda x: x).alias("ids")), ["o_orderkey"])
    return f.sizes()


def p38_problems(spark, sf_dir):
    """Invariants of token rows of which some lack a token, some ids are twice there, and some not at all."""
    t = token_table(spark, sf_dir).filter("vec_id % 40 <> 7")
    t = t.withColumn("old_log_prob", F.when(F.col("vec_id") % 50 == 3, F.slice("old_log_prob", 1, 63)).otherwise(F.col("old_log_prob")))
    return SampleFrame(t.unionByName(t.filter("vec_id % 30 = 4"))).problems(["old_log_prob", "log_prob", "response_mask"])


def r03_indexed(spark, sf_dir):
    """One position, a slice, a list, and a condition, one after the other."""
    o = _orders(spark, sf_dir)
    parts = [o[-1], o[10:100:7], o[[3, 3, 0]], o[F.col("o_custkey") % 100 == 7], o[[False, True, True]]]
    return SampleFrame.concat(parts).df.select(ROW, "o_orderkey")


def r04_reversed(spark, sf_dir):
    o = _orders(spark, sf_dir)
    n = o.count()
    order = o.df.select(F.col(ROW).alias("old"), (F.lit(n) - 1 - F.col(ROW)).alias("new"))
    return o.reorder(order).df.select(ROW, "o_orderkey")


def t02_split(spark, sf_dir):
    """Pieces of 4,000 rows, each numbered anew."""
    return _orders(spark, sf_dir).pieces(4000).select("piece", ROW, "o_orderkey")


def t03_batches(spark, sf_dir):
    """Two epochs of ten mini-batches: in order, and permuted, where only what a batch must keep is shown."""
    padded, _ = _orders(spark, sf_dir).pad_to_divisor(10)
    size, out = padded.count() // 10, None
    for seed in (None, 5):
        for i, f in enumerate(padded.batches(size, epochs=2, seed=seed)):
            part = f.df.agg(F.lit(seed is not None).alias("permuted"), F.lit(i // 10).cast("long").alias("epoch"), F.count("*").alias("rows"), F.max(ROW).alias("last"), F.sum("o_orderkey").alias("keys"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("permuted", "epoch").agg(F.count("*").alias("batches"), F.min("rows").alias("least"), F.max("rows").alias("most"), F.max("last").alias("last"), F.sum("keys").alias("keys"))


def t06_unpadded(spark, sf_dir):
    """Padded to a multiple of 64, then cut back."""
    padded, n = _orders(spark, sf_dir).pad_to_divisor(64)
    return padded.unpad(n).df.select(ROW, "o_orderkey")


def t07_padded_ends(spark, sf_dir):
    """Three copies of the last row, then two of the first."""
    return _orders(spark, sf_dir).pad(3).pad(2, first=True).df.select(ROW, "o_orderkey")


def j07_equal(spark, sf_dir):
    """Frames against themselves, another order of columns, one value changed, one row less."""
    o = _orders(spark, sf_dir).select(["o_orderkey", "o_custkey"])
    other = [o, o.select(["o_custkey", "o_orderkey"]), o.assign(o_custkey=F.when(F.col(ROW) == 5, -1).otherwise(F.col("o_custkey"))), o.slice(0, -1)]
    return spark.createDataFrame([(i, o.equals(x)) for i, x in enumerate(other)], "frame long, same boolean")


QUERIES = {f.__name__: f for f in (p02_pop_and_union, p09_get_and_assign, p05_info, p06_sizes, p38_problems, r03_indexed, r04_reversed, t02_split, t03_batches, t06_unpadded, t07_padded_ends, j07_equal)}
ORACLES = {
    "p02_pop_and_union": f"SELECT row_id, o_orderkey, o_custkey AS customer FROM {_O}",
    "p09_get_and_assign": f"SELECT row_id, o_custkey AS there, 1.5::DOUBLE AS missing, 'x' AS kind, round(o_totalprice * 2, 2) AS double_price FROM {_O}",
    "p05_info": "SELECT * FROM (VALUES ('o_custkey', 'bigint'), ('o_orderkey', 'bigint'), ('o_totalprice', 'double'), ('row_id', 'bigint')) t(\"column\", \"type\")",
    "p06_sizes": "SELECT 'o_orderkey' AS \"column\", 8 * count(*) AS bytes FROM orders UNION ALL SELECT 'o_orderpriority', CAST(sum(strlen(o_orderpriority)) AS BIGINT) FROM orders UNION ALL SELECT 'parts', CAST(sum(strlen(replace(o_orderpriority, '-', ''))) AS BIGINT) FROM orders UNION ALL SELECT 'ids', CAST(sum(8 * (o_custkey % 3 + 1)) AS BIGINT) FROM orders",
    "p38_problems": "WITH t AS (SELECT vec_id FROM embeddings WHERE vec_id % 40 <> 7) SELECT 'repeated_ids' AS \"check\", count(*) FILTER (vec_id % 30 = 4) AS n FROM t UNION ALL SELECT 'missing_ids', max(vec_id) + 1 - count(*) FROM t UNION ALL SELECT 'unequal_lengths', 2 * (count(*) FILTER (vec_id % 50 = 3) + count(*) FILTER (vec_id % 50 = 3 AND vec_id % 30 = 4)) FROM t",
    "r03_indexed": f"WITH o AS (SELECT *, count(*) OVER () AS n FROM {_O}), x AS (SELECT 0 AS k, 0 AS i, o_orderkey FROM o WHERE row_id = n - 1 UNION ALL SELECT 1, row_id, o_orderkey FROM o WHERE row_id BETWEEN 10 AND 99 AND (row_id - 10) % 7 = 0 UNION ALL SELECT 2, w.i, o_orderkey FROM (VALUES (0, 3), (1, 3), (2, 0)) w(i, p) JOIN o ON row_id = p UNION ALL SELECT 3, row_id, o_orderkey FROM o WHERE o_custkey % 100 = 7 UNION ALL SELECT 4, row_id, o_orderkey FROM o WHERE row_id IN (1, 2)) SELECT row_number() OVER (ORDER BY k, i) - 1 AS row_id, o_orderkey FROM x",
    "r04_reversed": f"SELECT n - 1 - row_id AS row_id, o_orderkey FROM (SELECT *, count(*) OVER () AS n FROM {_O})",
    "t02_split": f"SELECT row_id // 4000 AS piece, row_id % 4000 AS row_id, o_orderkey FROM {_O}",
    "t03_batches": f"WITH o AS (SELECT *, count(*) OVER () AS n FROM {_O}), p AS (SELECT o_orderkey FROM o UNION ALL SELECT o_orderkey FROM o WHERE row_id < (10 - n % 10) % 10), a AS (SELECT count(*) // 10 AS size, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM p) SELECT permuted, epoch, 10::BIGINT AS batches, size AS least, size AS most, size - 1 AS last, keys FROM a, (VALUES (false), (true)) b(permuted), (VALUES (0::BIGINT), (1)) e(epoch)",
    "t06_unpadded": f"SELECT row_id, o_orderkey FROM {_O}",
    "t07_padded_ends": f"WITH o AS (SELECT *, count(*) OVER () AS n FROM {_O}) SELECT row_id, o_orderkey FROM o UNION ALL SELECT n + k, o_orderkey FROM o, range(3) r(k) WHERE row_id = n - 1 UNION ALL SELECT n + 3 + k, o_orderkey FROM o, range(2) r(k) WHERE row_id = 0",
    "j07_equal": "SELECT * FROM (VALUES (0::BIGINT, true), (1, true), (2, false), (3, false)) t(frame, same)",
}

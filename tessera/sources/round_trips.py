"""Registered queries of sources and sinks: what is written is read back, through the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, written
from . import tables


def fan_out(rows: DataFrame, sinks: dict[str, object]) -> None:
    """The same metric rows to several sinks, each a function of the frame; the frame is made once."""
    kept = written(rows, "metrics")
    for sink in sinks.values():
        sink(kept)


def validation_sample(df: DataFrame, keys: list[str], seed: int, most: int) -> DataFrame:
    """``most`` rows in a seeded order that depends on the keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most)


def generated(df: DataFrame, prompt: str, model, n: int, out: str = "responses", size: int = 256) -> DataFrame:
    """``df`` with ``n`` responses a row from a user's model, which takes a list of prompts and gives lists of responses."""
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    def run(frames):
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                yield part.assign(**{out: model(part[prompt].tolist(), n)})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, ArrayType(StringType()))]))


# --- queries ---
def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")


def s02_chats(spark, sf_dir):
    """Messages read from files of which only some have tools and the thinking flag."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    root = shared_path(spark, "chats")
    c.filter("conv_id % 2 = 0").write.parquet(f"{root}/a")
    c.filter("conv_id % 2 = 1").withColumn("tools", F.lit("[]")).write.parquet(f"{root}/b")
    got = tables.read_chats(spark, [f"{root}/a", f"{root}/b"])
    return got.select(F.size("messages").alias("turns"), F.md5(F.to_json("messages")).alias("digest"), "tools", "enable_thinking").groupBy("turns", "tools", "enable_thinking").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("digests"))


def s04_pairs(spark, sf_dir):
    root = shared_path(spark, "pairs")
    _orders(spark, sf_dir).select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("good"), F.lit("bad").alias("worse")).write.parquet(root)
    return tables.read_pairs(spark, [root], "q", "good", "worse")


def s08_saved_batch(spark, sf_dir):
    """A batch saved and loaded with its meta."""
    root = shared_path(spark, "batch")
    tables.save_frame(_orders(spark, sf_dir), {"step": 7, "names": ["a", "b"]}, root)
    rows, meta = tables.load_frame(spark, root)
    return rows.select("o_orderkey", "o_custkey", F.lit(meta["step"]).cast("long").alias("step"), F.lit(",".join(meta["names"])).alias("names"))


def s10_generations(spark, sf_dir):
    """Rollouts of steps written as JSON lines and read for one step, strings masked."""
    root = shared_path(spark, "generations")
    o = _orders(spark, sf_dir).withColumn("step", F.col("o_orderkey") % 4)
    tables.write_generations(o, root)
    return tables.read_generations(spark, root, "o_orderkey long, o_custkey long, o_orderpriority string, step long", mask="[0-9]-", strings=["o_orderpriority"]).filter("step = 2")


def s14_dual(spark, sf_dir):
    """The same rows from the Parquet and from the JSON lines of a dual sink."""
    root = shared_path(spark, "dual")
    tables.write_dual(_orders(spark, sf_dir), root)
    a = spark.read.parquet(f"{root}/parquet")
    b = spark.read.schema(a.schema).json(f"{root}/jsonl")
    return a.exceptAll(b).agg(F.count("*").alias("only_parquet")).crossJoin(b.agg(F.count("*").alias("lines"), F.sum("o_orderkey").alias("keys")))


def s15_exported(spark, sf_dir):
    """Responses of a prompt flattened to a line each and read back."""
    from ..plans.curation import flattened_responses

    root = shared_path(spark, "export")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("responses"))
    flattened_responses(li, "responses").write.json(root)
    return spark.read.schema("l_orderkey long, sample_id long, response long").json(root)


def s17_sinks(spark, sf_dir):
    """One set of metrics to a Parquet table and to lines of text; rows as both have them."""
    root = shared_path(spark, "sinks")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("event_id") / 500).cast("long").alias("step")).agg(F.count("*").alias("n"), F.max("user_id").alias("top"))
    fan_out(e, {"table": lambda d: d.write.parquet(f"{root}/table"), "lines": lambda d: tables.metric_lines(d, "step", ["n", "top"]).write.text(f"{root}/lines")})
    lines = spark.read.text(f"{root}/lines").select(F.from_json("value", "step long, data struct<n: long, top: long>").alias("v")).select("v.step", F.col("v.data.top").alias("line_top"))
    return spark.read.parquet(f"{root}/table").join(lines, "step")


def s21_generated(spark, sf_dir):
    """Responses from a model, here one that counts words, appended as lists."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = generated(d, "text", lambda prompts, n: [[f"{len((p or '').split())} words", *(f"answer {k}" for k in range(1, n))] for p in prompts], 3)
    return got.select("doc_id", F.array_join("responses", "|").alias("responses"))


def s24_reused(spark, sf_dir):
    """The second call under the same configuration reads what the first one wrote; another one does not."""
    root = shared_path(spark, "reuse")
    o = _orders(spark, sf_dir)
    first = tables.reuse(spark, root, {"a": 1, "b": [2]}, lambda: o.filter("o_orderkey % 2 = 0"))
    again = tables.reuse(spark, root, {"b": [2], "a": 1}, lambda: o.filter("o_orderkey % 3 = 0"))
    other = tables.reuse(spark, root, {"a": 2}, lambda: o.filter("o_orderkey % 3 = 0"))
    count = lambda d, n: d.agg(F.count("*").alias(n))
    return count(first, "first").crossJoin(count(again, "again")).crossJoin(count(other, "other"))


def s03_nested(spark, sf_dir):
    """A column reached through a struct and a list of one."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.array(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("who"))).alias("extra"))
    return o.select("o_orderkey", tables.nested(o, "extra", ["who", "id"]).alias("id"))


def t17_sampled(spark, sf_dir):
    """A seeded sample for a log: as many rows as asked for, the same in another partitioning."""
    o = _orders(spark, sf_dir)
    a, b = validation_sample(o, ["o_orderkey"], 42, 50), validation_sample(o.repartition(7), ["o_orderkey"], 42, 50)
    return a.join(b.select(F.col("o_orderkey").alias("k")), F.col("k") == F.col("o_orderkey")).agg(F.count("*").alias("same"))


def s07_copied(spark, sf_dir):
    """A table copied by Spark's own reader and writer, whatever file systems its paths name."""
    root = shared_path(spark, "copy")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(root)
    return spark.read.parquet(root).select("n_nationkey", "n_name")


QUERIES = {f.__name__: f for f in (s02_chats, s03_nested, s04_pairs, s08_saved_batch, s10_generations, s14_dual, s15_exported, s17_sinks, s21_generated, s24_reused, s07_copied, t17_sampled)}
ORACLES = {
    "s02_chats": "WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT turns::INT AS turns, CASE WHEN conv_id % 2 = 1 THEN '[]' END AS tools, NULL::VARCHAR AS enable_thinking, count(*) AS n, count(DISTINCT (SELECT md5(string_agg(turn || coalesce(role, '') || coalesce(text, ''), chr(1) ORDER BY turn)) FROM conversations x WHERE x.conv_id = c.conv_id)) AS digests FROM c GROUP BY 1, 2",
    "s03_nested": "SELECT o_orderkey, o_custkey AS id FROM orders",
    "s04_pairs": "SELECT o_orderkey AS prompt, o_orderpriority AS chosen, 'bad' AS rejected FROM orders",
    "s07_copied": "SELECT n_nationkey, n_name FROM nation",
    "s08_saved_batch": "SELECT o_orderkey, o_custkey, 7::BIGINT AS step, 'a,b' AS names FROM orders",
    "s10_generations": "SELECT o_orderkey, o_custkey, '*' || o_orderpriority[3:] AS o_orderpriority, 2::BIGINT AS step FROM orders WHERE o_orderkey % 4 = 2",
    "s14_dual": "SELECT 0::BIGINT AS only_parquet, count(*) AS lines, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders",
    "s15_exported": "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS sample_id, l_partkey AS response FROM lineitem",
    "s17_sinks": "SELECT event_id // 500 AS step, count(*) AS n, max(user_id) AS top, max(user_id) AS line_top FROM events GROUP BY 1",
    "s21_generated": r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) || ' words|answer 1|answer 2' AS responses FROM documents",
    "s24_reused": "SELECT count(*) FILTER (o_orderkey % 2 = 0) AS first, count(*) FILTER (o_orderkey % 2 = 0) AS again, count(*) FILTER (o_orderkey % 3 = 0) AS other FROM orders",
    "t17_sampled": "SELECT 50::BIGINT AS same",
}

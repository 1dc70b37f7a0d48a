"""Registered queries of dataset shapes: extraction into rows, folds into extra columns, choices, media, prompts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import arrays, balance
from ..operators.frame import with_row_id
from . import curation


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


def p18_response_mask(spark, sf_dir):
    """The last three entries of a mask of eight."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("o_custkey") + i) % 3 > 0).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(arrays.response_mask(mask, 3), "").alias("mask"))


def p20_extracted(spark, sf_dir):
    """Truths out of solutions: behind the mark, and out of the box."""
    k = F.col("o_orderkey").cast("string")
    t = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("so 3 x 4\n#### 1,"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(" #### 7")).alias("a"), F.concat(F.lit("is $\\boxed{\\frac{"), k, F.lit("}{3}}$.")).alias("b"))
    return t.select("o_orderkey", answers.first_marked_number(F.col("a")).alias("marked"), answers.unboxed(answers.boxed(F.col("b"))).alias("boxed"))


def p23_cleaned(spark, sf_dir):
    t = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("  How to [title] do"), F.lit(" [step] "), "o_orderpriority", F.lit("  now ")).alias("t"))
    return t.select("o_orderkey", curation.wiki_cleaned(F.col("t")).alias("text"))


def p28_folded(spark, sf_dir):
    """All columns but the key move into one; the truth is the first that is not blank."""
    t = _orders(spark, sf_dir).withColumn("solution", F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")))
    return curation.folded_into_extra(t, ["o_orderkey"], ["solution", "o_orderpriority"]).select("o_orderkey", "ground_truth", F.size(F.json_object_keys(F.to_json("extra_info", {"ignoreNullFields": "false"}))).alias("columns"), F.col("extra_info.o_custkey").alias("customer"))


def p30_choices(spark, sf_dir):
    """The letter names the correct choice, and all choices are there once."""
    o = _orders(spark, sf_dir)
    text, letter = curation.multiple_choice(F.lit("Which?"), F.concat(F.lit("right "), "o_orderstatus"), F.array(F.lit("wrong 1"), F.lit("wrong 2"), F.lit("wrong 3")), F.col("o_orderkey"))
    t = o.select("o_orderkey", "o_orderstatus", text.alias("t"), letter.alias("l"))
    named = F.regexp_extract("t", r"(?m)^([A-D])\) right", 1)
    return t.select("o_orderkey", (named == F.col("l")).alias("named"), F.size(F.regexp_extract_all("t", F.lit(r"(?m)^[A-D]\) (right|wrong)"), F.lit(1))).alias("choices"), F.col("t").contains("Which?\n\nA) ").alias("asked"))


def p33_prompts(spark, sf_dir):
    """A begun assistant turn, and an instruction that is added once."""
    o = _orders(spark, sf_dir)
    once = curation.with_instruction(F.col("o_orderpriority"), "Think.")
    return o.select("o_orderkey", F.md5(curation.continuation_prompt(F.col("o_orderpriority"), F.col("o_orderstatus"))).alias("digest"), curation.with_instruction(once, "Think.").alias("text"))


def p37_media(spark, sf_dir):
    t = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "<image>").otherwise(""), F.lit("see"), F.when(F.col("o_orderkey") % 3 == 0, "<video><image>").otherwise(" it")).alias("t"))
    parts = curation.media_segments(F.col("t"))
    return t.select("o_orderkey", F.array_join(F.transform(parts, lambda p: p["type"]), ",").alias("types"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("-"))), "|").alias("texts"))


def t10_in_order(spark, sf_dir):
    """Each row to the least loaded of four bins, in order: how the loads of 64 rows stand."""
    placed = balance.dealt_in_order(balance._sequences(spark, sf_dir), "batch", "row", "length", 4)
    loads = placed.groupBy("batch", "partition").agg(F.count("*").alias("n"), F.sum("length").alias("load"), F.max("length").alias("top"))
    # a batch of fewer rows than bins has empty ones
    least = F.when(F.count("*") < 4, 0).otherwise(F.min("load"))
    return loads.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("load").alias("total"), (F.max("load") - least <= F.max("top")).alias("even"))


def t22_head_split(spark, sf_dir):
    o = with_row_id(_orders(spark, sf_dir), ["o_orderkey"])
    a, b = curation.head_split(o, "row_id", 0.8, o.count())
    return a.agg(F.lit("head").alias("part"), F.count("*").alias("n"), F.max("row_id").alias("last")).unionByName(b.agg(F.lit("rest").alias("part"), F.count("*").alias("n"), F.max("row_id").alias("last")))


def r15_by_request(spark, sf_dir):
    """One request, whatever dashes its id has."""
    ids = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("ab-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-cd")).alias("request"))
    return arrays.by_request(ids, "request", "ab0000-0100cd").select("o_orderkey", "request")


def t20_by_score(spark, sf_dir):
    """Places by score, then by the second score where there is no first."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_custkey") * 1.0).alias("score"), (F.col("o_custkey") + 0.5).alias("score_1"))
    placed = with_row_id(o.withColumn("_s", -F.coalesce("score", "score_1")), ["_s", "o_orderkey"], "place")
    first = arrays.by_score(o, descending=True).limit(10)  # a report of the ten best
    best = first.agg(F.min(F.coalesce("score", "score_1")).alias("_least"))
    return placed.select("o_orderkey", "place", (-F.col("_s")).alias("score")).crossJoin(F.broadcast(best)).withColumn("among_best", F.col("score") >= F.col("_least")).drop("_least")


def w21_opposite(spark, sf_dir):
    """For every line the mean quantity of its order's lines of the other return."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("acc"))
    g = li.groupBy(F.col("l_orderkey").alias("_o")).agg(F.collect_list("l_quantity").alias("s"), F.collect_list("acc").alias("a"))
    j = li.join(g, F.col("l_orderkey") == F.col("_o"))
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(arrays.opposite_mean("s", "a", F.col("acc")), 5).alias("opposite"))


def f76_valid(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    g = c.withColumn("text", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), "  ").otherwise(F.col("text")))
    m = curation.conversations(g, "conv_id", "turn", "role", "text")
    return m.select("conv_id", F.coalesce(answers.valid_messages(F.col("messages")), F.lit(False)).alias("valid"))


QUERIES = {f.__name__: f for f in (p18_response_mask, p20_extracted, p23_cleaned, p28_folded, p30_choices, p33_prompts, p37_media, t10_in_order, t22_head_split, r15_by_request, t20_by_score, w21_opposite, f76_valid)}
ORACLES = {
    "p18_response_mask": "SELECT o_orderkey, ((o_custkey + 5) % 3 > 0)::INT || '' || ((o_custkey + 6) % 3 > 0)::INT || ((o_custkey + 7) % 3 > 0)::INT AS mask FROM orders",
    "p20_extracted": r"SELECT o_orderkey, '1' || lpad(o_custkey::VARCHAR, 6, '0') AS marked, '\frac{' || o_orderkey || '}{3}' AS boxed FROM orders",
    "p23_cleaned": "SELECT o_orderkey, 'How to. do ' || o_orderpriority || ' now' AS text FROM orders",
    "p28_folded": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE o_orderpriority END AS ground_truth, 4::INT AS columns, o_custkey AS customer FROM orders",
    "p30_choices": "SELECT o_orderkey, true AS named, 4::INT AS choices, true AS asked FROM orders",
    "p33_prompts": "SELECT o_orderkey, md5('<|im_start|>user' || chr(10) || o_orderpriority || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || o_orderstatus) AS digest, o_orderpriority || ' Think.' AS text FROM orders",
    "p37_media": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'image,' ELSE '' END || 'text' || CASE WHEN o_orderkey % 3 = 0 THEN ',video,image' ELSE '' END AS types, CASE WHEN o_orderkey % 2 = 0 THEN '-|' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'see|-|-' ELSE 'see it' END AS texts FROM orders",
    "t10_in_order": f"SELECT batch, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, true AS even FROM {balance._SEQ} GROUP BY 1",
    "t22_head_split": "WITH c AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.8) AS BIGINT) AS h FROM orders) SELECT 'head' AS part, h AS n, h - 1 AS last FROM c UNION ALL SELECT 'rest', n - h, n - 1 FROM c",
    "r15_by_request": "SELECT o_orderkey, 'ab-' || lpad(o_orderkey::VARCHAR, 8, '0') || '-cd' AS request FROM orders WHERE o_orderkey = 100",
    "t20_by_score": "WITH t AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 100 = 0 THEN o_custkey ELSE o_custkey + 0.5 END)::DOUBLE AS score FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) - 1 AS place FROM t) SELECT o_orderkey, place, score, score >= (SELECT score FROM p WHERE place = 9) AS among_best FROM p",
    "w21_opposite": "WITH t AS (SELECT *, (l_returnflag = 'R')::INT AS a FROM lineitem), g AS (SELECT l_orderkey, avg(l_quantity) FILTER (a = 0) AS m0, avg(l_quantity) FILTER (a = 1) AS m1 FROM t GROUP BY 1) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(CASE WHEN a = 1 THEN m0 ELSE m1 END, 0), 5) AS opposite FROM t JOIN g USING (l_orderkey)",
    "f76_valid": "SELECT conv_id, bool_and(CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN false ELSE coalesce(trim(text, ' ') <> '', false) END) AS valid FROM conversations GROUP BY 1",
}

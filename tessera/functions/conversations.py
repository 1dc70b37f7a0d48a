"""Metrics of whole conversations by name: BLEU of the completion, tokens said, turns; what fails or is not there counts 0.

N-grams are rows: both sides' multisets meet in one aggregation by conversation and gram, which clips the counts.  Tasks get
whole conversations of a bounded sum of characters; the grams of a very long one are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import message_tokens, tolerant_json

#: What a zero count of a longer gram counts as, where some shorter gram is shared (the smallest normal double).
TINY = 2.2250738585072014e-308

METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    """Register a function of (rows with _row, messages and truth columns) that gives _row and value."""

    def add(f):
        if METRICS.get(name, f) is not f:
            raise ValueError(f"{name!r} is taken")
        METRICS[name] = f
        return f

    return add


#: Characters of both sides that a task's n-grams are made from, and from which on a row's n-grams are dealt out by themselves.
TASK_CHARS, LONG = 1 << 19, 1 << 20


def _hits(sides: DataFrame, order: int) -> DataFrame:
    """Clipped matches of each gram length, by row; rows that already lie together by ``_row`` stay where they are."""
    lengths = F.sequence(F.lit(1), F.lit(order))
    two = F.explode(F.array(F.struct(F.col("c").alias("t"), F.lit(1).alias("own")), F.struct(F.col("r").alias("t"), F.lit(0).alias("own"))))
    each = sides.select("_row", two.alias("x")).select("_row", "x.t", "x.own", F.explode(lengths).alias("k"))
    each = each.filter(F.char_length("t") >= F.col("k"))
    each = each.select("_row", "k", "own", "t", F.explode(F.sequence(F.lit(1), F.char_length("t") - F.col("k") + 1)).alias("_i"))
    each = each.select("_row", "k", "own", F.substring(F.col("t"), F.col("_i"), F.col("k")).alias("g"))
    counts = each.groupBy("_row", "k", "g").agg(F.sum("own").alias("a"), F.sum(1 - F.col("own")).alias("b"))
    return counts.groupBy("_row", "k").agg(F.sum(F.least("a", "b")).alias("hit"))


def bleu(df: DataFrame, row: str, candidate: str, reference: str, order: int = 4) -> DataFrame:
    """``row`` and bleu: the brevity penalty times the geometric mean of clipped precisions of 1 to ``order`` characters.

    Without a common character the score is 0; a longer gram that is never shared counts as ``TINY``.  Null and empty texts
    score 0; rows with equal ids are taken together, so ids must be distinct.  A text shorter than a gram has one in the
    denominator.

    Rows are dealt out whole, ``TASK_CHARS`` characters a task by their sum, and their grams counted where they are; a row
    of ``LONG`` characters has its grams dealt out.
    """
    sides = df.select(F.col(row).alias("_row"), F.coalesce(F.col(candidate), F.lit("")).alias("c"), F.coalesce(F.col(reference), F.lit("")).alias("r"))
    chars = F.char_length("c").cast("long") + F.char_length("r")
    total, longest = sides.agg(F.sum(chars), F.max(chars)).first()
    hits = _hits(sides.filter(chars < LONG).repartition((total or 0) // TASK_CHARS + 1, "_row"), order)
    if (longest or 0) >= LONG:
        hits = hits.unionByName(_hits(sides.filter(chars >= LONG), order))
    sizes = sides.select("_row", F.char_length("c").alias("n"), F.char_length("r").alias("m"))
    places = F.greatest(F.col("n") - F.col("k") + 1, F.lit(1))
    logs = hits.join(sizes, "_row").select("_row", "k", "hit", F.log(F.when(F.col("hit") > 0, F.col("hit").cast("double")).otherwise(TINY) / places).alias("log"))
    found = logs.groupBy("_row").agg(F.sum("log").alias("log"), F.count("*").alias("ks"), F.max(F.when(F.col("k") == 1, F.col("hit"))).alias("first"))
    # gram lengths that neither side has are zero hits of one
    mean = (F.col("log") + (order - F.col("ks")) * math.log(TINY)) / order
    penalty = F.when(F.col("n") > F.col("m"), 1.0).otherwise(F.exp(1 - F.col("m") / F.col("n")))
    score = F.when((F.col("n") > 0) & (F.col("first") > 0), penalty * F.exp(mean)).otherwise(0.0)
    return sizes.join(found, "_row", "left").select(F.col("_row").alias(row), F.coalesce(score, F.lit(0.0)).alias("bleu"))


def final_completion(text: Column) -> Column:
    """The final_completion of a judge's JSON object, if it has a thought beside it; else null."""
    told = tolerant_json(text)
    fields = F.from_json(told, "final_completion string, thought string")
    return F.when(fields["thought"].isNotNull(), fields["final_completion"])


def last_said(messages: Column) -> Column:
    """The last assistant's turn."""
    said = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.try_element_at(said, F.lit(-1))["content"]


@metric("bleu_score")
def _bleu_score(df: DataFrame, messages: str, truth: str) -> DataFrame:
    rows = df.select("_row", last_said(F.col(messages)).alias("_c"), F.col(truth).alias("_r"))
    return bleu(rows, "_row", "_c", "_r").withColumnRenamed("bleu", "value")


@metric("token_amount")
def _token_amount(df: DataFrame, messages: str, truth: str) -> DataFrame:
    return df.select("_row", message_tokens(F.col(messages), F.lit(1)).cast("double").alias("value"))


@metric("turns")
def _turns(df: DataFrame, messages: str, truth: str) -> DataFrame:
    return df.select("_row", F.size(messages).cast("double").alias("value"))


def conversation_metrics(df: DataFrame, key: str, messages: str, truth: str, names: Sequence[str], prefix: str = "") -> DataFrame:
    """``key`` and a column a name: 0 where there is no such metric, and where a conversation's value is null."""
    rows = df.select(F.col(key).alias("_row"), F.col(messages), F.col(truth))
    out = rows.select("_row")
    for name in names:
        if name in METRICS:
            found = METRICS[name](rows, messages, truth).select(F.col("_row").alias("_of"), F.col("value").alias("_v"))
            out = out.join(found, F.col("_row") == F.col("_of"), "left").withColumn(prefix + name, F.coalesce("_v", F.lit(0.0))).drop("_of", "_v")
        else:
            out = out.withColumn(prefix + name, F.lit(0.0))
    return out.withColumnRenamed("_row", key)


# --- queries ---
def _chats(spark, sf_dir) -> DataFrame:
    """Conversations with the last user's turn as the truth."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("l"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("truth"))
    return g.select("conv_id", F.transform("l", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), "truth")


def f47_completion_bleu(spark, sf_dir):
    """A judge's JSON with the completion, of which some are broken, against the last user's turn."""
    t = _chats(spark, sf_dir).withColumn("told", F.when(F.col("conv_id") % 5 == 0, "no json").otherwise(F.concat(F.lit("so: "), F.to_json(F.struct(F.lit("t").alias("thought"), last_said(F.col("messages")).alias("final_completion"))))))
    rows = t.select("conv_id", final_completion(F.col("told")).alias("completion"), "truth")
    return bleu(rows, "conv_id", "completion", "truth").select("conv_id", F.round("bleu", 9).alias("bleu"))


def x30_conversation_metrics(spark, sf_dir):
    done = conversation_metrics(_chats(spark, sf_dir), "conv_id", "messages", "truth", ["bleu_score", "token_amount", "turns", "interactivity"])
    return done.select("conv_id", F.round("bleu_score", 9).alias("bleu_score"), "token_amount", "turns", "interactivity")


QUERIES = {f.__name__: f for f in (f47_completion_bleu, x30_conversation_metrics)}
_BLEU = """t AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS c, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS r, any_value(conv_id % 5 = 0) AS broken, count(*) AS turns,
        (SELECT coalesce(sum(len(regexp_split_to_array(trim(x.text, ' '), '\\s+'))), 0) FROM (SELECT y.text, row_number() OVER (ORDER BY y.turn) AS i FROM conversations y WHERE y.conv_id = o.conv_id) x WHERE x.i > 1) AS tokens FROM conversations o GROUP BY 1),
    g AS (SELECT conv_id, k, c[i:i + k - 1] AS g, 1 AS a, 0 AS b FROM t, range(1, 5) x(k), range(1, 100000) y(i) WHERE i <= length(c) - k + 1 UNION ALL SELECT conv_id, k, r[i:i + k - 1], 0, 1 FROM t, range(1, 5) x(k), range(1, 100000) y(i) WHERE i <= length(r) - k + 1),
    h AS (SELECT conv_id, k, least(sum(a), sum(b)) AS hit FROM g GROUP BY 1, 2, g.g), p AS (SELECT conv_id, k, sum(hit) AS hit FROM h GROUP BY 1, 2),
    l AS (SELECT conv_id, sum(ln(CASE WHEN hit > 0 THEN hit ELSE 2.2250738585072014e-308 END / greatest(length(c) - k + 1, 1))) / 4 AS m, max(hit) FILTER (k = 1) AS first, count(*) AS ks FROM p JOIN t USING (conv_id) GROUP BY 1),
    s AS (SELECT t.*, CASE WHEN length(c) > 0 AND first > 0 AND ks = 4 THEN exp(m) * CASE WHEN length(c) > length(r) THEN 1 ELSE exp(1 - length(r) / length(c)) END ELSE 0 END AS bleu FROM t LEFT JOIN l USING (conv_id))"""
ORACLES = {
    "f47_completion_bleu": f"WITH {_BLEU} SELECT conv_id, round(CASE WHEN broken THEN 0 ELSE bleu END, 9)::DOUBLE AS bleu FROM s",
    "x30_conversation_metrics": f"WITH {_BLEU} SELECT conv_id, round(bleu, 9)::DOUBLE AS bleu_score, tokens::DOUBLE AS token_amount, turns::DOUBLE AS turns, 0.0::DOUBLE AS interactivity FROM s",
}

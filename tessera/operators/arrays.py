"""Shapes of token rows: padding, truncation, masks of prompts and turns, resampling, and lookups in dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded(ids: Column, width: int, pad, left: bool = False) -> Column:
    """Pad to ``width`` on the right or left; longer arrays stay as they are."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def truncated(ids: Column, width: int, how: str = "error") -> Column:
    """At most ``width`` elements: keep the end ("left" is cut), the start ("right"), both ends ("middle"), or raise."""
    n = F.size(ids)
    head = width // 2
    cut = {
        "left": F.slice(ids, F.greatest(n - width + 1, F.lit(1)), F.lit(width)),
        "right": F.slice(ids, 1, width),
        "middle": F.concat(F.slice(ids, 1, head), F.slice(ids, F.greatest(n - (width - head) + 1, F.lit(1)), F.lit(width - head))),
        "error": F.raise_error(F.concat(F.lit(f"longer than {width}: "), n.cast("string"))).cast("array<bigint>"),
    }[how]
    return F.when(n > width, cut.cast("array<bigint>")).otherwise(ids.cast("array<bigint>"))


def fixed_width(ids: Column, width: int, pad: int, *, left: bool = True, how: str = "error") -> Column:
    """Exactly ``width`` tokens."""
    return padded(truncated(ids, width, how), width, pad, left)


def without_padding(ids: str, mask: str) -> Column:
    """The ids under the mask."""
    return F.transform(F.filter(F.arrays_zip(ids, mask), lambda t: t[mask] != 0), lambda t: t[ids])


def response_mask(mask: Column, response: int) -> Column:
    """The last ``response`` entries of an attention mask."""
    return F.slice(mask, -response, response)


def completed_mask(done: str, actions: int = 7) -> Column:
    """1 up to and including the first completed step (everywhere, if none is), each step's value for all action slots."""
    first = F.array_position(F.transform(done, lambda x: x.cast("boolean")), True)
    steps = F.transform(done, lambda x, i: F.when((first == 0) | (i < first), 1).otherwise(0))
    return F.flatten(F.transform(steps, lambda x: F.array_repeat(x, actions)))


def sft_loss_mask(prompt: Column, total: Column) -> Column:
    """1 where the next token is to be learnt: none of the first prompt - 1 positions, nor the last position."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.when((i < prompt - 1) | (i == total - 1), 0).otherwise(1))).otherwise(F.array().cast("array<int>"))


def turn_loss_mask(turns: str, header: int = 0) -> Column:
    """For an array of (role, n tokens): 1 on the assistants' tokens after their ``header`` tokens, else 0."""
    return F.flatten(F.transform(turns, lambda t: F.transform(F.sequence(F.lit(0), F.greatest(t["n"], F.lit(1)) - 1), lambda i: F.when((t["role"] == "assistant") & (i >= header), 1).otherwise(0))))


def resampled(df: DataFrame, row: str, weight: Column, seed: int = 0) -> DataFrame:
    """As many rows as there are, drawn with replacement in proportion to the weights.

    Systematic draws: copy j of n goes to the row whose share of the running weight covers (j + u) / n, so a row's number of
    copies is within one of its expectation.  The running weight comes from ranges of rows and their sums.
    """
    from .frame import running, with_row_id

    rows = with_row_id(df, [row], "_pos").withColumn("_w", weight.cast("double"))
    size = 4096
    cell = F.expr(f"_pos div {size}")
    sums = rows.groupBy(cell.alias("_c")).agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_n"))
    starts = running(sums, "_c", "_s", "_b").select("_c", F.coalesce("_b", F.lit(0.0)).alias("_before"))
    total = sums.agg(F.sum("_s").alias("_total"), F.sum("_n").alias("_rows"))
    w = Window.partitionBy("_cell").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_cell", cell).join(starts, F.col("_cell") == F.col("_c")).crossJoin(F.broadcast(total)).withColumn("_to", F.col("_before") + F.sum("_w").over(w))
    u = F.lit(((seed * 48271 + 12345) % 1_000_003 + 0.5) / 1_000_003)  # plain arithmetic, so that any engine gives the same
    upto = lambda x: F.ceil(x / F.col("_total") * F.col("_rows") - u)
    copies = (upto(F.col("_to")) - upto(F.col("_to") - F.col("_w"))).cast("int")
    return placed.withColumn("_k", copies).filter("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k")))).select(*df.columns)


def block_leave_one_out(reward: Column, row: Column, n: int) -> Column:
    """Each row's reward less the mean of the others in its block of n consecutive rows."""
    w = Window.partitionBy(F.floor(row / n))
    return reward - (F.sum(reward).over(w) - reward) / (n - 1)


def opposite_mean(scores: str, accs: str, own_acc: Column) -> Column:
    """Mean score of a group's rollouts of the other accuracy; 0 without any."""
    other = F.filter(F.arrays_zip(scores, accs), lambda t: t[accs] != own_acc)
    s = F.aggregate(other, F.lit(0.0), lambda a, t: a + t[scores])
    return F.coalesce(F.try_divide(s, F.size(other)), F.lit(0.0))


def by_request(df: DataFrame, column: str, request: str) -> DataFrame:
    """Point lookup of an id, whatever its dashes."""
    return df.filter(F.replace(column, F.lit("-"), F.lit("")) == request.replace("-", ""))


def matching_lines(df: DataFrame, text: str, needle: str) -> DataFrame:
    """The numbers (from 0) and texts of the lines that hold the needle."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n")).alias("line", "match")).filter(F.col("match").contains(needle))


def by_score(df: DataFrame, descending: bool | None = None) -> DataFrame:
    """Sorted by score (or score_1, or 0); None leaves the order."""
    if descending is None:
        return df
    have = [F.col(c) for c in ("score", "score_1") if c in df.columns]
    key = F.coalesce(*have, F.lit(0.0))
    return df.orderBy(F.desc(key) if descending else F.asc(key))


# --- queries ---
def _ids(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l")).select("l_orderkey", F.col("l.l_partkey").alias("ids"), F.transform("l", lambda x: (x["l_suppkey"] % 3 > 0).cast("int")).alias("mask"))


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def u19_padded(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", _joined(padded(F.col("ids"), 5, 0)).alias("right_padded"), _joined(padded(F.col("ids"), 5, 0, left=True)).alias("left_padded"))


def u20_truncated(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", *[_joined(truncated(F.col("ids"), 3, how)).alias(how) for how in ("left", "right", "middle")])


def r12_without_padding(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", _joined(without_padding("ids", "mask")).alias("kept"))


def u28_completed_mask(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", F.aggregate(completed_mask("mask"), F.lit(0), lambda a, x: a + x).alias("n"))


def f54_sft_loss_mask(spark, sf_dir):
    return _ids(spark, sf_dir).select("l_orderkey", _joined(sft_loss_mask(F.lit(2), F.size("ids"))).alias("mask"))


def w13_block_leave_one_out(spark, sf_dir):
    from .frame import with_row_id

    o = with_row_id(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return o.select("o_orderkey", F.round(block_leave_one_out(F.col("o_totalprice"), F.col("row_id"), 4), 4).alias("reward"))


def w22_resampled(spark, sf_dir):
    """Draws by weight: how often each order comes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 10).alias("w"))
    return resampled(o, "o_orderkey", F.col("w"), seed=3).groupBy("o_orderkey").agg(F.count("*").alias("copies"))


def r16_matching_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matching_lines(d, "text", "icense").select("doc_id", F.col("line").cast("long").alias("line"), F.md5("match").alias("digest"))


QUERIES = {f.__name__: f for f in (u19_padded, u20_truncated, r12_without_padding, u28_completed_mask, f54_sft_loss_mask, w13_block_leave_one_out, w22_resampled, r16_matching_lines)}
_L = "l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids, list((l_suppkey % 3 > 0)::INT ORDER BY l_linenumber, l_partkey, l_suppkey) AS m, count(*) AS n FROM lineitem GROUP BY 1)"
_ZEROS = "list_transform(range(greatest(5 - n, 0)::BIGINT), lambda x: 0)"
ORACLES = {
    "u19_padded": f"WITH {_L} SELECT l_orderkey, array_to_string(list_concat(ids, {_ZEROS}), ',') AS right_padded, array_to_string(list_concat({_ZEROS}, ids), ',') AS left_padded FROM l",
    "u20_truncated": f"WITH {_L} SELECT l_orderkey, array_to_string(CASE WHEN n > 3 THEN ids[-3:] ELSE ids END, ',') AS left, array_to_string(ids[:3], ',') AS right, array_to_string(CASE WHEN n > 3 THEN list_concat(ids[:1], ids[-2:]) ELSE ids END, ',') AS middle FROM l",
    "r12_without_padding": "WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), k AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS kept FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1) SELECT l_orderkey, coalesce(kept, '') AS kept FROM o LEFT JOIN k USING (l_orderkey)",
    "u28_completed_mask": f"WITH {_L} SELECT l_orderkey, (7 * CASE WHEN list_position(m, 1) IS NULL OR list_position(m, 1) = 0 THEN n ELSE list_position(m, 1) END)::INT AS n FROM l",
    "f54_sft_loss_mask": f"WITH {_L} SELECT l_orderkey, array_to_string(list_transform(range(n), lambda i: CASE WHEN i < 1 OR i = n - 1 THEN 0 ELSE 1 END), ',') AS mask FROM l",
    "w13_block_leave_one_out": "WITH o AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 4 AS b FROM orders) SELECT o_orderkey, round(o_totalprice - (sum(o_totalprice) OVER (PARTITION BY b) - o_totalprice) / 3, 4) AS reward FROM o",
    "w22_resampled": f"WITH o AS (SELECT o_orderkey, (o_custkey % 10)::DOUBLE AS w, sum(o_custkey % 10) OVER (ORDER BY o_orderkey)::DOUBLE AS t, sum(o_custkey % 10) OVER ()::DOUBLE AS s, count(*) OVER () AS n FROM orders), c AS (SELECT o_orderkey, CAST(ceil(t / s * n - {((3 * 48271 + 12345) % 1_000_003 + 0.5) / 1_000_003!r}::DOUBLE) - ceil((t - w) / s * n - {((3 * 48271 + 12345) % 1_000_003 + 0.5) / 1_000_003!r}::DOUBLE) AS BIGINT) AS copies FROM o) SELECT * FROM c WHERE copies > 0",
    "r16_matching_lines": "SELECT doc_id, i - 1 AS line, md5(s[i]) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), range(1, 30001) r(i) WHERE i <= len(s) AND contains(s[i], 'icense')",
}

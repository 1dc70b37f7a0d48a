"""Texts that repeat themselves, by suffix order: many texts at once in one array, without a loop over characters.

Ranks of prefixes of 1, 2, 4, ... characters come from sorting pairs of ranks; they hold the text's number, so suffixes of
different texts never mix.  The common prefix of neighbours in suffix order is read off the kept ranks by halving.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose suffixes are ordered at once (a longer text is taken alone).
BLOCK_CHARS = 1 << 18


def _refined(at: np.ndarray, rank: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Suffixes of known ranks by a further key: their new ranks, and the suffixes so sorted with whether they share one."""
    by = np.lexsort((key, rank))
    at, rank, key = at[by], rank[by], key[by]
    old = np.r_[True, rank[1:] != rank[:-1]]
    new = old | np.r_[True, key[1:] != key[:-1]]
    place = np.arange(len(at))
    first = lambda starts: np.maximum.accumulate(np.where(starts, place, 0))
    alone = new & np.r_[new[1:], True]
    return rank + first(new) - first(old), (at, ~alone)


def prefix_sums(texts: list[str]) -> np.ndarray:
    """For each text the sum of the common prefixes of neighbours in the order of its suffixes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(len(texts), np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    # a rank is the place of the first suffix of its group; only groups of several suffixes are sorted again
    rank, open_ = _refined(np.arange(n), np.zeros(n, np.int64), (doc << 21) | code)
    ranks = np.empty(n, np.int64)
    ranks[open_[0]] = rank
    active = open_[0][open_[1]]
    levels, k = [ranks.astype(np.int32)], 1
    while len(active):
        to = active + k
        inside = to < n
        inside[inside] = doc[to[inside]] == doc[active[inside]]
        behind = np.zeros(len(active), np.int64)
        behind[inside] = ranks[to[inside]] + 1
        new, (at, several) = _refined(active, ranks[active], behind)
        ranks[at] = new
        active = at[several]
        levels.append(ranks.astype(np.int32))
        k *= 2
    order = np.empty(n, np.int64)
    order[ranks] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + common, b + common
        inside = (p < n) & (q < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][p[inside]] == levels[k][q[inside]]
        common += same.astype(np.int64) << k
    return np.bincount(doc[a], common, len(texts)).astype(np.int64)


def shares(texts: list[str | None]) -> np.ndarray:
    """Twice the sum of common prefixes over n (n + 1); 0 for null and for texts of less than two characters."""
    whole, out, at = [t or "" for t in texts], np.zeros(len(texts)), 0
    while at < len(whole):
        to, size = at, 0
        while to < len(whole) and (to == at or size + len(whole[to]) <= BLOCK_CHARS):
            size, to = size + len(whole[to]), to + 1
        n = np.array([len(t) for t in whole[at:to]], np.float64)
        out[at:to] = np.where(n > 1, 2 * prefix_sums(whole[at:to]) / np.maximum(n * (n + 1), 1), 0.0)
        at = to
    return out


def repetition_share(text: Column) -> Column:
    @F.arrow_udf("double")
    def share(text: pa.Array) -> pa.Array:
        return pa.array(shares(text.to_pylist()), pa.float64())

    return share(text)


def repeats_itself(text: Column, above: float = 0.2) -> Column:
    return repetition_share(text) > above


# --- queries ---
def f40_repetition(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", repeats_itself(F.col("text")).alias("repeats"))


def f40_repetition_share(spark, sf_dir):
    """Short texts that repeat themselves more or less: a priority and a key, once to four times."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = o.select("o_orderkey", F.expr("repeat(concat(o_orderpriority, o_orderkey), cast(o_custkey % 4 as int))").alias("t"))
    return t.select("o_orderkey", F.round(repetition_share(F.col("t")), 9).alias("share"), repeats_itself(F.col("t")).alias("repeats"))


QUERIES = {f.__name__: f for f in (f40_repetition, f40_repetition_share)}
ORACLES = {
    "f40_repetition_share": """WITH t AS (SELECT o_orderkey, repeat(o_orderpriority || o_orderkey, o_custkey % 4) AS t FROM orders), s AS (SELECT o_orderkey, length(t) AS n, t[i:] AS s FROM t, range(1, 80) r(i) WHERE i <= length(t)),
        p AS (SELECT o_orderkey, n, s, lag(s) OVER (PARTITION BY o_orderkey ORDER BY s) AS b FROM s), c AS (SELECT o_orderkey, any_value(n) AS n, sum(coalesce(len(list_filter(range(1, 80), lambda k: k <= length(s) AND k <= length(b) AND s[1:k] = b[1:k])), 0)) AS c FROM p GROUP BY 1)
        SELECT o_orderkey, coalesce(round(2 * c / (n * (n + 1)), 9), 0)::DOUBLE AS share, coalesce(2 * c / (n * (n + 1)) > 0.2, false) AS repeats FROM t LEFT JOIN c USING (o_orderkey)""",
}

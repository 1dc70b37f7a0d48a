"""Validation from responses to named metrics, with the exact distribution of what the bootstrap draws.

Of k draws with replacement from n values the best is the i-th smallest with probability (i/n)^k - ((i-1)/n)^k.  The
majority's value is, given which vote wins, any of that vote's values alike, and a vote wins by the multinomial law of the
draws' counts, where a tie goes to any of the tied alike (the first drawn).  So means and deviations need no draws.
"""

from __future__ import annotations

from functools import cache, lru_cache
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import FEW, KEPT, _lines, _six, by_pattern, metric_sums, named_metrics, subset_sizes


@cache
def win_probabilities(counts: tuple[int, ...], k: int) -> tuple[float, ...]:
    """For votes with ``counts`` values each: the probability that each is the majority of k draws with replacement.

    For a winner with m draws the others' draws follow a product of exponential series, each cut at m: a recursion over
    votes of coefficients by the number of draws and of ties.
    """
    p, out = np.array(counts) / sum(counts), []
    for c in range(len(counts)):
        total = 0.0
        for m in range(1, k + 1):
            ways = np.zeros((k - m + 1, len(counts)))  # draws of others, others that tie
            ways[0, 0] = 1.0
            for j in range(len(counts)):
                if j == c:
                    continue
                new = np.zeros_like(ways)
                for d in range(min(m, k - m) + 1):
                    term = p[j] ** d / factorial(d)
                    if d < m:
                        new[d:] += term * ways[: k - m + 1 - d]
                    else:
                        new[d:, 1:] += term * ways[: k - m + 1 - d, :-1]
                ways = new
            ties = ways[k - m] / np.arange(1, len(counts) + 1)
            total += p[c] ** m / factorial(m) * ties.sum()
        out.append(float(total * factorial(k)))
    return tuple(out)


def _vote_shares(pattern: bytes, k: int) -> np.ndarray:
    """For each response, the probability that the majority of k draws is its value, by the pattern of votes."""
    code = np.frombuffer(pattern, np.int32)
    count = np.bincount(code, minlength=len(code))
    there = np.flatnonzero(count)
    by = there[np.argsort(count[there], kind="stable")]
    win = np.zeros(len(code))
    win[by] = win_probabilities(tuple(count[by].tolist()), k)
    return (win / np.maximum(count, 1))[code]


_vote_shares_kept = lru_cache(KEPT)(_vote_shares)


def exact_prompt_metrics(values: np.ndarray, votes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """mean@n, std@n, and the exact mean and deviation of best@k, worst@k and maj@k of prompts with n responses each."""
    n = values.shape[1]
    out = {f"mean@{n}": values.mean(1)}
    if n < 2:
        return out
    out[f"std@{n}"] = values.std(1)
    ranked, i = np.sort(values, axis=1), np.arange(n + 1) / n
    for k in subset_sizes(n):
        up = np.diff(i**k)
        laws = {"best": (ranked, np.broadcast_to(up, ranked.shape)), "worst": (ranked, np.broadcast_to(up[::-1], ranked.shape))}
        if votes is not None:
            law = _vote_shares_kept if n <= FEW else _vote_shares
            laws["maj"] = (values, by_pattern(votes, lambda p, k=k, law=law: law(p, k)))
        for kind, (x, w) in laws.items():
            mean = (x * w).sum(1)
            out[f"{kind}@{k}/mean"], out[f"{kind}@{k}/std"] = mean, np.sqrt(np.maximum((x * x * w).sum(1) - mean**2, 0))
    return out


def exact_validation_metrics(df: DataFrame, source: str, uid: str, value: str, vote: str | None = None) -> DataFrame:
    """source, metric, value, prompts: the mean over prompts of each metric, by source.

    As ``metrics.validation_metrics``, with exact laws instead of draws, so neither a seed nor the rows' order matters.  A
    prompt's responses become one row; a null source is a source (the empty string), null values are not counted.
    """
    item = F.struct(F.col(value).cast("double").alias("v"), F.coalesce((F.col(vote) if vote else F.lit("")).cast("string"), F.lit("")).alias("p"))
    given = df.filter(F.col(value).isNotNull())
    prompts = given.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(uid)).agg(F.collect_list(item).alias("_l"))
    prompts = prompts.select("source", F.col("_l.v").alias("values"), F.col("_l.p").alias("votes"))
    return metric_sums(prompts, exact_prompt_metrics, vote is not None)


def validated(prompts: DataFrame, *, uid: str, source: str, responses: str, score: Column, acc: Column | None = None, pred: Column | None = None, turns: str | None = None) -> DataFrame:
    """name and value of every validation metric, from prompts with their responses.

    Each response becomes a row (response), is scored by ``score`` (reward) and, where they are given, ``acc`` and ``pred``,
    expressions over the prompt's columns and response.  The core variable is acc where there is one, else reward: its
    mean, majority and best at a source's largest number are val-core, all else val-aux; turns add their least, most and mean.
    """
    each = prompts.withColumn("response", F.explode(responses))
    each = each.withColumns({"reward": score.cast("double"), "acc": acc.cast("double") if acc is not None else F.lit(None).cast("double"), "pred": pred if pred is not None else F.lit(None).cast("string")})
    out = None
    for variable in ("reward", *(["acc"] if acc is not None else [])):
        m = named_metrics(exact_validation_metrics(each, source, uid, variable, "pred" if pred is not None else None), variable)
        if acc is not None and variable == "reward":
            m = m.withColumn("name", F.regexp_replace("name", "^val-core/", "val-aux/"))
        m = m.select("name", "value")
        out = m if out is None else out.unionByName(m)
    if turns:
        t = prompts.select(F.explode(F.array_repeat(F.col(turns), F.size(responses))).alias("t")).agg(F.min("t").alias("min"), F.max("t").alias("max"), F.avg("t").alias("mean"))
        out = out.unionByName(t.select(F.inline(F.array(*[F.struct(F.lit(f"val-aux/num_turns/{k}").alias("name"), F.col(k).cast("double").alias("value")) for k in ("min", "max", "mean")]))))
    return out


# --- queries ---
def a12_exact(spark, sf_dir):
    """Lines of an order as responses, their return flags as votes: all metrics by line status."""
    return _six(named_metrics(exact_validation_metrics(_lines(spark, sf_dir), "l_linestatus", "l_orderkey", "l_quantity", "l_returnflag")), 6).select("source", "metric", "value", "prompts", "name")


def a44_validated(spark, sf_dir):
    """Four responses of each order, scored by whether they end in its customer's digit; predictions are their last digits."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("source"), (F.col("o_custkey") % 3 + 2).alias("turns"))
    said = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("so it is "), ((F.col("o_custkey") + F.floor(i / 2) * (F.col("o_orderkey") % 3)) % 10).cast("string")))
    right = F.substring("response", -1, 1) == (F.col("o_custkey") % 10).cast("string")
    return _six(validated(o.withColumn("responses", said), uid="o_orderkey", source="source", responses="responses", score=F.when(right, 1.0).otherwise(-0.5), acc=right.cast("double"), pred=F.substring("response", -1, 1), turns="turns"), 6)


QUERIES = {f.__name__: f for f in (a12_exact, a44_validated)}


def _exact_sql(rows: str) -> str:
    """source, metric, total over prompts and their number, of rows (source, uid, v, p): votes are few, so all counts of a
    draw are listed."""
    return f"""r AS ({rows}), q AS (SELECT source, uid, v, p, row_number() OVER (PARTITION BY source, uid ORDER BY v) AS i, count(*) OVER (PARTITION BY source, uid) AS n FROM r),
        u AS (SELECT source, uid, any_value(n) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM q GROUP BY 1, 2), k AS (SELECT n, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16], lambda x: x < n), n))) AS k FROM (SELECT DISTINCT n FROM u WHERE n > 1)),
        b AS (SELECT source, uid, k, sum(v * w) AS m1, sum(v * v * w) AS m2, sum(v * z) AS w1, sum(v * v * z) AS w2 FROM (SELECT q.*, k.k, (i / n) ** k - ((i - 1) / n) ** k AS w, ((n - i + 1) / n) ** k - ((n - i) / n) ** k AS z FROM q JOIN k USING (n)) GROUP BY 1, 2, 3),
        c AS (SELECT source, uid, any_value(n) AS n, p, count(*) AS c, avg(v) AS a1, avg(v * v) AS a2 FROM q GROUP BY 1, 2, p), l AS (SELECT source, uid, any_value(n) AS n, list(c ORDER BY p) AS cs, list(a1 ORDER BY p) AS a1, list(a2 ORDER BY p) AS a2 FROM c GROUP BY 1, 2),
        d AS (SELECT DISTINCT cs, n, k FROM l JOIN k USING (n)), e AS (SELECT cs, n, k, j1, j2, k - j1 - j2 AS j3 FROM d, range(0, 17) a(j1), range(0, 17) b(j2) WHERE j1 + j2 <= k AND (len(cs) > 1 OR j2 = 0 AND j1 = k) AND (len(cs) > 2 OR j1 + j2 = k)),
        f AS (SELECT cs, n, k, [j1, j2, j3] AS j, factorial(k::INT) / (factorial(j1::INT) * factorial(j2::INT) * factorial(j3::INT)) * (cs[1] / n) ** j1 * (coalesce(cs[2], 0) / n) ** j2 * (coalesce(cs[3], 0) / n) ** j3 AS p FROM e),
        g AS (SELECT cs, n, k, x, sum(CASE WHEN j[x] = list_max(j) THEN p / len(list_filter(j, lambda y: y = list_max(j))) ELSE 0 END) AS win FROM f, range(1, 4) t(x) WHERE x <= len(cs) GROUP BY 1, 2, 3, 4),
        h AS (SELECT source, uid, k, sum(win * a1[x]) AS m1, sum(win * a2[x]) AS m2 FROM l JOIN g USING (cs, n) GROUP BY 1, 2, 3),
        m AS (SELECT source, 'mean@' || n AS metric, mean AS x FROM u UNION ALL SELECT source, 'std@' || n, std FROM u WHERE n > 1 UNION ALL SELECT source, 'best@' || k || '/mean', m1 FROM b UNION ALL SELECT source, 'best@' || k || '/std', sqrt(greatest(m2 - m1 * m1, 0)) FROM b
          UNION ALL SELECT source, 'worst@' || k || '/mean', w1 FROM b UNION ALL SELECT source, 'worst@' || k || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM b UNION ALL SELECT source, 'maj@' || k || '/mean', m1 FROM h UNION ALL SELECT source, 'maj@' || k || '/std', sqrt(greatest(m2 - m1 * m1, 0)) FROM h),
        t AS (SELECT source, metric, avg(x) AS value, count(*) AS prompts, regexp_extract(metric, '@(\\d+)', 1)::INT AS top FROM m GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN top = max(top) OVER (PARTITION BY source) AND (metric LIKE 'mean@%' OR metric LIKE 'maj@%/mean' OR metric LIKE 'best@%/mean') THEN 'val-core' ELSE 'val-aux' END AS part FROM t)"""


_SAID = "SELECT o_orderkey, o_orderpriority[1] AS source, ((o_custkey + i // 2 * (o_orderkey % 3)) % 10)::VARCHAR AS p, (o_custkey + i // 2 * (o_orderkey % 3)) % 10 = o_custkey % 10 AS ok FROM orders, range(4) t(i)"
ORACLES = {
    "a12_exact": f"WITH {_exact_sql('SELECT l_linestatus AS source, l_orderkey AS uid, l_quantity::DOUBLE AS v, l_returnflag AS p FROM lineitem')} SELECT source, metric, round(value, 6) AS value, prompts, part || '/' || source || '/reward/' || metric AS name FROM s",
    "a44_validated": f"""WITH x AS (WITH {_exact_sql(f"SELECT source, o_orderkey AS uid, CASE WHEN ok THEN 1.0 ELSE -0.5 END::DOUBLE AS v, p FROM ({_SAID})")} SELECT 'val-aux/' || source || '/reward/' || metric AS name, value FROM s),
        y AS (WITH {_exact_sql(f"SELECT source, o_orderkey AS uid, ok::INT::DOUBLE AS v, p FROM ({_SAID})")} SELECT part || '/' || source || '/acc/' || metric AS name, value FROM s),
        z AS (SELECT min(o_custkey % 3 + 2) AS lo, max(o_custkey % 3 + 2) AS hi, avg(o_custkey % 3 + 2) AS mean FROM orders)
        SELECT name, round(value, 6) AS value FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT 'val-aux/num_turns/min', lo::DOUBLE FROM z UNION ALL SELECT 'val-aux/num_turns/max', hi FROM z UNION ALL SELECT 'val-aux/num_turns/mean', mean FROM z)""",
}

"""Advantages: each rollout's outcome score against the other rollouts of its prompt.

Every estimator is a function of a ``Batch`` - the names of the score, group, order and length columns - and gives a
column.  All group statistics use one window specification, so one exchange on the group serves any number of them; the
few estimators that need a statistic of the whole batch take it from a one-row table, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


@dataclass(frozen=True)
class Batch:
    score: str = "score"
    group: str = "uid"
    order: Sequence[str] = ("row_id",)  # a total order of rows, for ties and neighbours
    length: str = "length"
    options: dict = field(default_factory=dict)

    @property
    def window(self):
        return Window.partitionBy(self.group)

    def over(self, f: Column) -> Column:
        return f.over(self.window)

    @property
    def s(self) -> Column:
        return F.col(self.score)

    @property
    def size(self) -> Column:
        return self.over(F.count(F.lit(1)))


Estimator = Callable[[Batch], Column]
ESTIMATORS: dict[str, Estimator] = {}


def estimator(name: str):
    """Register under a name; a second function under one name is an error."""

    def add(f: Estimator) -> Estimator:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"the estimator {name!r} is registered already")
        ESTIMATORS[name] = f
        return f

    return add


def get_estimator(name: str) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def advantages(df: DataFrame, name: str, batch: Batch | None = None, out: str = "advantage") -> DataFrame:
    batch = batch or Batch()
    if name in BATCH_ESTIMATORS:
        return BATCH_ESTIMATORS[name](df, batch, out)
    return df.withColumn(out, get_estimator(name)(batch))


@estimator("grpo")
def grpo(b: Batch) -> Column:
    """(score - mean) / (sample deviation + epsilon); a group of one has mean 0 and deviation 1."""
    one, eps = b.size == 1, b.options.get("epsilon", EPSILON)
    centred = b.s - F.when(one, 0.0).otherwise(b.over(F.avg(b.s)))
    if not b.options.get("by_std", True):
        return centred
    return centred / (F.when(one, 1.0).otherwise(b.over(F.stddev_samp(b.s))) + eps)


@estimator("grpo_mean_only")
def grpo_mean_only(b: Batch) -> Column:
    return b.s - F.when(b.size == 1, 0.0).otherwise(b.over(F.avg(b.s)))


@estimator("grpo_vectorized")
def grpo_vectorized(b: Batch) -> Column:
    """As grpo, with the variance at least epsilon."""
    one, eps = b.size == 1, b.options.get("epsilon", EPSILON)
    std = F.sqrt(F.greatest(b.over(F.var_samp(b.s)), F.lit(eps)))
    return (b.s - F.when(one, 0.0).otherwise(b.over(F.avg(b.s)))) / (F.when(one, 1.0).otherwise(std) + eps)


@estimator("grpo_passk")
def grpo_passk(b: Batch) -> Column:
    """The best rollout gets its lead over the second (by the deviation), all others 0; a group of one raises."""
    w = Window.partitionBy(b.group).orderBy(F.desc(b.score), *b.order)
    lead = b.s - F.lead(b.s).over(w)
    if b.options.get("by_std", True):
        lead = lead / (b.over(F.stddev_samp(b.s)) + b.options.get("epsilon", EPSILON))
    bad = F.raise_error(F.lit("pass@k needs two rollouts a group")).cast("double") if b.options.get("strict", True) else F.lit(0.0)
    return F.when(b.size < 2, bad).when(F.row_number().over(w) == 1, lead).otherwise(0.0)


@estimator("rloo")
def rloo(b: Batch) -> Column:
    """Leave-one-out baseline; a group of one keeps its score."""
    n = b.size
    return F.when(n > 1, (n * b.s - b.over(F.sum(b.s))) / F.greatest(n - 1, F.lit(1))).otherwise(b.s)


@estimator("rloo_vectorized")
def rloo_vectorized(b: Batch) -> Column:
    """As rloo, but a group of one gets 0."""
    n = b.size
    return F.when(n > 1, (n * b.s - b.over(F.sum(b.s))) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)


@estimator("opo")
def opo(b: Batch) -> Column:
    """The baseline is the length-weighted mean score; a group of one has baseline 0."""
    length = F.col(b.length)
    return b.s - F.when(b.size == 1, 0.0).otherwise(F.try_divide(b.over(F.sum(length * b.s)), b.over(F.sum(length))))


@estimator("group_baseline")
def group_baseline(b: Batch) -> Column:
    return b.s - F.when(b.size == 1, 0.0).otherwise(b.over(F.avg(b.s)))


def _with_scalar(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Attach statistics of the whole batch (one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))


def _gpg(df: DataFrame, b: Batch, out: str) -> DataFrame:
    """Group-centred score times rows / max(nonzero scores, 1), over f_norm."""
    rows = _with_scalar(df, _rows=F.count(F.lit(1)), _hits=F.count_if(b.s != 0))
    return rows.withColumn(out, F.col("_rows") / F.greatest(F.col("_hits"), F.lit(1)) * group_baseline(b) / b.options.get("f_norm", 1.0)).drop("_rows", "_hits")


def _reinforce_baseline(df: DataFrame, b: Batch, out: str) -> DataFrame:
    """Group-centred scores, every token alike, whitened over all tokens: row sums weighted by length suffice."""
    rows = df.withColumn("_x", group_baseline(b)).withColumn("_l", F.col(b.length).cast("double"))
    n = F.sum("_l")
    mean = F.sum(F.col("_l") * F.col("_x")) / (n + 1e-8)
    rows = _with_scalar(rows, _n=n, _mean=mean)
    rows = rows.crossJoin(F.broadcast(rows.agg((F.sum(F.col("_l") * (F.col("_x") - F.col("_mean")) ** 2) / (F.sum("_l") + 1e-8) * F.sum("_l") / (F.sum("_l") - 1)).alias("_var"))))
    return rows.withColumn(out, (F.col("_x") - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_x", "_l", "_n", "_mean", "_var")


def soft_mean(df: DataFrame, score: str, beta: float) -> DataFrame:
    """One row: (logsumexp(beta x) - log n) / beta, shifted by the maximum; the mean for beta 0."""
    if beta == 0:
        return df.agg(F.avg(score).alias("soft_mean"))
    rows = _with_scalar(df, _top=F.max(beta * F.col(score)))
    return rows.agg((F.log(F.avg(F.exp(beta * F.col(score) - F.col("_top")))) / beta + F.max("_top") / beta).alias("soft_mean"))


def _sppo(df: DataFrame, b: Batch, out: str) -> DataFrame:
    return df.crossJoin(F.broadcast(soft_mean(df, b.score, b.options.get("beta", 1.0)))).withColumn(out, b.s - F.col("soft_mean")).drop("soft_mean")


#: Estimators that need statistics of the whole batch: (df, batch, out) -> df.
BATCH_ESTIMATORS: dict[str, Callable[[DataFrame, Batch, str], DataFrame]] = {"gpg": _gpg, "reinforce_plus_plus_baseline": _reinforce_baseline, "sppo": _sppo}


def token_advantages(df: DataFrame, name: str, *, rewards: str, mask: str = "response_mask", values: str | None = None, baselines: str | None = None, batch: Batch | None = None, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Token columns ``advantages`` and ``returns`` by the estimator of that name.

    "gae" needs values, "remax" baselines (a reward a row), "reinforce_plus_plus" neither; any group estimator takes a row's
    sum of rewards as its score and gives every token under the mask the same.
    """
    from . import tokens as T

    if name == "gae":
        if not values:
            raise ValueError("gae needs values")
        return T.gae_batch(df, rewards, values, mask, gamma, lam)
    on = lambda c: T.each([c, mask], lambda t: t[c] * t[mask])
    if name == "reinforce_plus_plus":
        rows = df.withColumn("returns", T.discounted_returns(rewards, mask, gamma))
        return T.masked_whiten(rows, "returns", "_white", mask).withColumn("advantages", on("_white")).drop("_white")
    if name == "remax":
        if not baselines:
            raise ValueError("remax needs baselines")
        rows = df.withColumn("_r", on(rewards)).withColumn("returns", T.discounted_returns("_r", mask, 1.0, reset=False))
        rows = rows.withColumn("_b", F.transform(mask, lambda m: m * F.col(baselines)))
        return rows.withColumn("advantages", T.each(["returns", "_b"], lambda t: t["returns"] - t["_b"])).drop("_r", "_b")
    b = batch or Batch()
    rows = advantages(df.withColumn(b.score, F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)), name, b, "_a")
    rows = rows.withColumn("advantages", F.transform(mask, lambda m: m * F.col("_a")))
    return rows.withColumn("returns", F.col("advantages")).drop("_a")


def mixed_leave_one_out(df: DataFrame, row: str, n: int, *, rewards: str | None = None, accuracy: str | None = None, length: str = "length", mask: str = "response_mask", reward_share: float = 1.0, accuracy_share: float = 1.0) -> DataFrame:
    """Token columns ``returns`` (reward-to-go) and ``advantages`` (whitened) of ``n`` consecutive rows a prompt.

    Two sources of reward, each against the others of its block: token rewards under the mask, whose baseline is the sum of
    the rows' means, and the accuracy at a row's last token (``length``).  Each is scaled by n / (n - 1), less its baseline
    over n - 1, weighted and added.
    """
    from . import tokens as T

    if not (rewards or accuracy) or n < 2:
        raise ValueError("rewards or accuracies, and two rows a prompt, are needed")
    w = Window.partitionBy(F.floor(F.col(row) / n))
    rows = df.withColumn("_at", F.transform(mask, lambda m, i: i))
    parts: list[Callable[[Column], Column]] = []
    if rewards:
        s = T.sums([rewards], mask, v=lambda t: t[rewards])
        rows = rows.withColumn("_mean", F.try_divide(s["v"], s["n"])).withColumn("_base", F.array_repeat(F.sum("_mean").over(w) / (n - 1), F.size(mask)))
        parts.append(lambda t: F.when(t[mask] != 0, t[rewards] * (n / (n - 1)) - t["_base"]).otherwise(0.0) * reward_share)
    if accuracy:
        own = (F.col(accuracy) * (n / (n - 1)) - F.sum(accuracy).over(w) / (n - 1)) * accuracy_share
        rows = rows.withColumn("_own", own).withColumn("_end", F.transform("_at", lambda i: F.when(i == F.col(length) - 1, F.col("_own")).otherwise(0.0)))
        parts.append(lambda t: t["_end"])
    used = [mask, *([rewards, "_base"] if rewards else []), *(["_end"] if accuracy else [])]
    rows = rows.withColumn("_total", T.each(used, lambda t: sum((p(t) for p in parts), F.lit(0.0)) * t[mask]))
    rows = rows.withColumn("returns", T.discounted_returns("_total", mask, 1.0, reset=False))
    return T.masked_whiten(rows, "returns", "advantages", mask).drop("_at", "_mean", "_base", "_own", "_end", "_total")


def pair_preference(df: DataFrame, b: Batch, row: str = "row_id", out: str = "preferred") -> DataFrame:
    """Of rows 2k and 2k + 1 the one of higher score (the first, if equal) is preferred; an odd number of rows raises."""
    w = Window.partitionBy(F.expr(f"{row} div 2")).orderBy(F.desc(b.score), row)
    odd = F.count(F.lit(1)).over(Window.partitionBy(F.expr(f"{row} div 2"))) != 2
    return df.withColumn(out, F.when(odd, F.raise_error(F.lit("pairs need an even number of rows")).cast("boolean")).otherwise(F.row_number().over(w) == 1))


def consistent_groups(df: DataFrame, b: Batch) -> DataFrame:
    """Dynamic sampling: groups whose scores differ, and groups of one."""
    return df.withColumn("_keep", (b.over(F.stddev_pop(b.s)) > 0) | (b.size == 1)).filter("_keep").drop("_keep")


def filter_and_downsample(df: DataFrame, b: Batch, low: float, high: float, oversample: float, truncated: str | None = None) -> DataFrame:
    """Groups whose mean score lies within the band (and none of which is truncated) come first, then the others in group
    order; floor(rows / oversample) rows are kept."""
    inside = b.over(F.avg(b.s)).between(low, high)
    if truncated:
        inside = inside & (b.over(F.max(F.col(truncated).cast("int"))) == 0)
    from .frame import with_row_id

    # rows are numbered by ranges, so no task sees all that are kept
    ranked = with_row_id(df.withColumn("_out", F.coalesce(1 - inside.cast("int"), F.lit(2))), ["_out", b.group, *b.order], "_at")
    return ranked.filter(F.col("_at") < int(df.count() // oversample)).drop("_out", "_at")


def run_numbers(df: DataFrame, key: str, order: str, out: str = "run_no") -> DataFrame:
    """0, 1, 2 ... while ``key`` stays equal (null to null) in the order of rows: gaps and islands.

    Rows are cut into cells of consecutive rows; a row's run begins at the last change in its cell, or else at the last
    one in the cells before it, which one row a cell tells.
    """
    from .frame import running, with_row_id

    rows = with_row_id(df, [order], "_pos").withColumn("_cell", F.expr("_pos div 4096"))
    cell = Window.partitionBy("_cell").orderBy("_pos")
    inner = F.when((F.row_number().over(cell) > 1) & ~F.col(key).eqNullSafe(F.lag(key).over(cell)), F.col("_pos"))
    rows = rows.withColumn("_change", inner)
    ends = rows.groupBy("_cell").agg(F.min_by(F.struct(key), "_pos").alias("_k0"), F.max_by(F.struct(key), "_pos").alias("_k1"), F.max("_change").alias("_last"), F.min("_pos").alias("_p0"))
    before = ends.select((F.col("_cell") + 1).alias("_next"), F.col("_k1").alias("_kb"))
    ends = ends.join(before, F.col("_cell") == F.col("_next"), "left")
    begins = F.col("_kb").isNull() | ~F.col("_k0").eqNullSafe(F.col("_kb"))
    ends = ends.select("_cell", F.when(begins, F.col("_p0")).alias("_own"), F.coalesce("_last", F.when(begins, F.col("_p0"))).alias("_value"))
    starts = running(ends, "_cell", "_value", "_carried", "max").select("_cell", F.coalesce("_own", "_carried").alias("_first"))
    start = F.coalesce(F.max("_change").over(cell.rowsBetween(Window.unboundedPreceding, 0)), F.col("_first"))
    return rows.join(starts, "_cell").withColumn(out, F.col("_pos") - start).drop("_pos", "_cell", "_change", "_first")


def select_best(df: DataFrame, group: str, item: str, accuracy: str) -> DataFrame:
    """Per group: the first item of highest accuracy, all items and accuracies in item order, mean, population deviation,
    range, and the lead of the best over the mean."""
    a = F.col(accuracy)
    lists = F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), a.alias("a"))))
    out = df.groupBy(group).agg(F.min_by(item, F.struct(-a, F.col(item))).alias("best_item"), F.max(a).alias("best_acc"), lists.alias("_l"), F.avg(a).alias("acc_mean"), F.stddev_pop(a).alias("acc_std"), (F.max(a) - F.min(a)).alias("acc_range"))
    return out.select(group, "best_item", "best_acc", F.col("_l.i").alias("all_items"), F.col("_l.a").alias("all_accs"), "acc_mean", "acc_std", "acc_range", (F.col("best_acc") - F.col("acc_mean")).alias("improvement_over_mean"))


# --- queries: lineitem as rollouts, an order's lines as a prompt's group ---
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_BATCH = Batch(score="l_quantity", group="l_orderkey", order=("l_linenumber", "l_partkey", "l_suppkey"), length="l_linenumber", options={"strict": False})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_KEYS, "l_quantity")


def _advantage(name: str, **options):
    def query(spark, sf_dir):
        b = Batch(_BATCH.score, _BATCH.group, _BATCH.order, _BATCH.length, {**_BATCH.options, **options})
        return advantages(_lines(spark, sf_dir), name, b).select(*_KEYS, F.round("advantage", 5).alias("advantage"))

    return query


def w14_soft_mean(spark, sf_dir):
    return soft_mean(_lines(spark, sf_dir), "l_quantity", 0.3).select(F.round("soft_mean", 6).alias("soft_mean"))


def w16_pair_preference(spark, sf_dir):
    from .frame import with_row_id

    o = with_row_id(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").alias("score")), ["o_orderkey"])
    return pair_preference(o, Batch()).select("row_id", "o_orderkey", "preferred")


def w17_run_numbers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return run_numbers(e, "event_type", "event_id")


def w20_select_best(spark, sf_dir):
    li = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("acc"))
    best = select_best(li, "l_orderkey", "l_linenumber", "acc")
    joined = [F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c) for c in ("all_items", "all_accs")]
    return best.select("l_orderkey", "best_item", "best_acc", *joined, *[F.round(c, 6).alias(c) for c in ("acc_mean", "acc_std", "acc_range", "improvement_over_mean")])


def r07_consistent_groups(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("score", F.floor(F.col("l_quantity") / 25))
    return consistent_groups(rows, Batch(group="l_orderkey")).select(*_KEYS, "score")


def r09_filter_and_downsample(spark, sf_dir):
    b = Batch(score="l_quantity", group="l_orderkey", order=("l_linenumber", "l_partkey", "l_suppkey"))
    return filter_and_downsample(_lines(spark, sf_dir), b, 20, 30, 2.0).select(*_KEYS)


NAMES = {"w02_group_advantage": ("grpo", {}), "w02_mean_only": ("grpo_mean_only", {}), "w03_group_advantage_vectorized": ("grpo_vectorized", {}), "w04_pass_at_k": ("grpo_passk", {}), "w05_group_baseline_whitened": ("reinforce_plus_plus_baseline", {}), "w06_leave_one_out": ("rloo", {}), "w07_leave_one_out_vectorized": ("rloo_vectorized", {}), "w08_length_weighted_baseline": ("opo", {}), "w11_gradient_normalized": ("gpg", {}), "w15_soft_mean_baseline": ("sppo", {"beta": 0.3})}
QUERIES = {k: _advantage(name, **options) for k, (name, options) in NAMES.items()} | {f.__name__: f for f in (w14_soft_mean, w16_pair_preference, w17_run_numbers, w20_select_best, r07_consistent_groups, r09_filter_and_downsample)}

_S = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({}, 5) AS advantage FROM lineitem WINDOW g AS (PARTITION BY l_orderkey)"
_ONE, _Q = "count(*) OVER g = 1", "l_quantity"
ORACLES = {
    "w02_group_advantage": _S.format(f"CASE WHEN {_ONE} THEN {_Q} / (1 + 1e-6) ELSE ({_Q} - avg({_Q}) OVER g) / (stddev_samp({_Q}) OVER g + 1e-6) END"),
    "w02_mean_only": _S.format(f"CASE WHEN {_ONE} THEN {_Q} ELSE {_Q} - avg({_Q}) OVER g END"),
    "w03_group_advantage_vectorized": _S.format(f"CASE WHEN {_ONE} THEN {_Q} / (1 + 1e-6) ELSE ({_Q} - avg({_Q}) OVER g) / (sqrt(greatest(var_samp({_Q}) OVER g, 1e-6)) + 1e-6) END"),
    "w04_pass_at_k": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN n < 2 OR r > 1 THEN 0 ELSE ({_Q} - nxt) / (sd + 1e-6) END, 5) AS advantage FROM (SELECT *, count(*) OVER g AS n, stddev_samp({_Q}) OVER g AS sd, row_number() OVER o AS r, lead({_Q}) OVER o AS nxt FROM lineitem WINDOW g AS (PARTITION BY l_orderkey), o AS (PARTITION BY l_orderkey ORDER BY {_Q} DESC, l_linenumber, l_partkey, l_suppkey))",
    "w05_group_baseline_whitened": f"WITH x AS (SELECT *, CASE WHEN {_ONE} THEN {_Q} ELSE {_Q} - avg({_Q}) OVER g END AS x, l_linenumber::DOUBLE AS l FROM lineitem WINDOW g AS (PARTITION BY l_orderkey)), m AS (SELECT sum(l * x) / (sum(l) + 1e-8) AS mu FROM x), v AS (SELECT any_value(mu) AS mu, sum(l * (x - mu) ^ 2) / (sum(l) + 1e-8) * sum(l) / (sum(l) - 1) AS var FROM x, m) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - mu) / sqrt(var + 1e-8), 5) AS advantage FROM x, v",
    "w06_leave_one_out": _S.format(f"CASE WHEN {_ONE} THEN {_Q} ELSE (count(*) OVER g * {_Q} - sum({_Q}) OVER g) / (count(*) OVER g - 1) END"),
    "w07_leave_one_out_vectorized": _S.format(f"CASE WHEN {_ONE} THEN 0 ELSE (count(*) OVER g * {_Q} - sum({_Q}) OVER g) / (count(*) OVER g - 1) END"),
    "w08_length_weighted_baseline": _S.format(f"CASE WHEN {_ONE} THEN {_Q} ELSE {_Q} - sum(l_linenumber * {_Q}) OVER g / sum(l_linenumber) OVER g END"),
    "w11_gradient_normalized": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((SELECT count(*) / greatest(count(*) FILTER ({_Q} <> 0), 1) FROM lineitem) * x, 5) AS advantage FROM (SELECT *, CASE WHEN {_ONE} THEN {_Q} ELSE {_Q} - avg({_Q}) OVER g END AS x FROM lineitem WINDOW g AS (PARTITION BY l_orderkey))",
    "w15_soft_mean_baseline": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_Q} - (SELECT ln(avg(exp(0.3 * {_Q} - 15))) / 0.3 + 50 FROM lineitem), 5) AS advantage FROM lineitem",
    "w14_soft_mean": f"SELECT round(ln(avg(exp(0.3 * {_Q} - 15))) / 0.3 + 50, 6) AS soft_mean FROM lineitem",
    "w16_pair_preference": "SELECT row_id, o_orderkey, row_number() OVER (PARTITION BY row_id // 2 ORDER BY floor(o_totalprice) DESC, row_id) = 1 AS preferred FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)",
    "w17_run_numbers": "WITH n AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS g FROM n) SELECT event_id, event_type, row_number() OVER (PARTITION BY g ORDER BY event_id) - 1 AS run_no FROM g",
    "w20_select_best": "WITH a AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS acc FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_min(l_linenumber, -acc * 1000 + l_linenumber) AS best_item, max(acc) AS best_acc, string_agg(l_linenumber::INT, ',' ORDER BY l_linenumber) AS all_items, string_agg(acc::INT, ',' ORDER BY l_linenumber) AS all_accs, round(avg(acc), 6) AS acc_mean, round(stddev_pop(acc), 6) AS acc_std, round(max(acc) - min(acc), 6) AS acc_range, round(max(acc) - avg(acc), 6) AS improvement_over_mean FROM a GROUP BY 1",
    "r07_consistent_groups": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM (SELECT *, floor(l_quantity / 25)::BIGINT AS score, count(*) OVER g AS n, min(floor(l_quantity / 25)) OVER g AS lo, max(floor(l_quantity / 25)) OVER g AS hi FROM lineitem WINDOW g AS (PARTITION BY l_orderkey)) WHERE lo < hi OR n = 1",
    "r09_filter_and_downsample": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) BETWEEN 20 AND 30 AS ok, count(*) OVER () AS n FROM lineitem) QUALIFY row_number() OVER (ORDER BY ok DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= n // 2",
}

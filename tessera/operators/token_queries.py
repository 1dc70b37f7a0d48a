"""Registered queries of the token operators, over ``embeddings`` as token arrays.

Position i (from 0) of a row with embedding e: old = -|e_i|, new = -|e_63-i|, advantage = e_(i+1) mod 64, reference =
-|e_i + 0.1|, value = e_i / 2, return = value + advantage / 2, prediction = -value; the mask is 1 below 10 + vec_id mod 55
but for every seventh position from 3 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T

WIDTH = 64.0


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    at = lambda i: F.get(F.col("e"), i)
    return e.select(
        "vec_id", F.col("vec_id").alias("row_id"), "label", "e",
        F.transform("e", lambda x, i: -F.abs(x)).alias(T.OLD), F.transform("e", lambda x, i: -F.abs(at(63 - i))).alias(T.NEW), F.transform("e", lambda x, i: at((i + 1) % 64)).alias(T.ADV),
        F.transform("e", lambda x, i: -F.abs(x + 0.1)).alias(T.REF), F.transform("e", lambda x, i: x / 2).alias(T.VALUES), F.transform("e", lambda x, i: x / 2 + at((i + 1) % 64) / 2).alias(T.RETURNS), F.transform("e", lambda x, i: -x / 2).alias(T.VPRED),
        F.transform("e", lambda x, i: ((i < 10 + F.col("vec_id") % 55) & (i % 7 != 3)).cast("int")).alias(T.MASK),
    )


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def a01_masked_mean(spark, sf_dir):
    return token_table(spark, sf_dir).select("vec_id", F.round(T.masked_sum(T.ADV), 5).alias("total"), F.round(T.masked_mean(T.ADV), 5).alias("mean"))


def a03_masked_var(spark, sf_dir):
    return rounded(T.masked_stats(token_table(spark, sf_dir), T.ADV))


def a06_loss_modes(spark, sf_dir):
    s = token_table(spark, sf_dir).select(T.sums([T.ADV], loss=lambda t: t[T.ADV] * t[T.ADV]).alias("s"))
    return rounded(s.agg(*[T.aggregate_loss("s", "loss", m, WIDTH).alias(m.replace("-", "_")) for m in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")]))


def w19_whiten(spark, sf_dir):
    w = T.masked_whiten(token_table(spark, sf_dir), T.ADV, "white")
    return w.select("vec_id", F.posexplode("white").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("white"))


def _loss(name: str, **options):
    def query(spark, sf_dir):
        return rounded(T.get_policy_loss(name)(token_table(spark, sf_dir), width=WIDTH, **options))

    return query


def l10_value_loss(spark, sf_dir):
    return rounded(T.value_loss(token_table(spark, sf_dir)))


def l12_divergences(spark, sf_dir):
    t = token_table(spark, sf_dir)
    rows = t.select(T.sums([T.OLD, T.REF], **{k: (lambda x, k=k: T.kl(x[T.OLD], x[T.REF], k)) for k in ("k1", "abs", "k2", "k3")}).alias("s"))
    return rounded(rows.agg(*[T.total_mean("s", k).alias(k) for k in ("k1", "abs", "k2", "k3")]))


def l16_kl_penalty(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("rewards", T.penalized_rewards(T.ADV, beta=0.2))
    return t.select("vec_id", F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def l16_batch_kl(spark, sf_dir):
    return rounded(T.batch_kl(token_table(spark, sf_dir)))


def l20_token_weights(spark, sf_dir):
    w = T.importance_weights(token_table(spark, sf_dir), "token", 1.05)
    return w.select("vec_id", F.round(F.aggregate("rollout_is_weights", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def l20_sequence_weights(spark, sf_dir):
    w = T.importance_weights(token_table(spark, sf_dir), "sequence", 2.0, normalize=True)
    return w.select("vec_id", F.round(F.array_max("rollout_is_weights"), 5).alias("weight"))


def l21_rejection(spark, sf_dir):
    t = token_table(spark, sf_dir)
    n = lambda d: d.select("vec_id", F.aggregate(T.MASK, F.lit(0), lambda a, x: a + x).cast("long").alias("n"))
    parts = [n(T.rejection_mask(t, level, 1.08)).withColumnRenamed("n", level) for level in ("token", "sequence", "geometric")]
    parts.append(n(T.rejection_mask(t, "token", 1.08, veto=0.91)).withColumnRenamed("n", "vetoed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "vec_id")
    return out


def l25_weight_metrics(spark, sf_dir):
    return rounded(T.weight_metrics(token_table(spark, sf_dir), 1.08, 1 / 1.08))


def l26_off_policy(spark, sf_dir):
    return rounded(T.off_policy_metrics(token_table(spark, sf_dir)), 4)


def l13_entropy(spark, sf_dir):
    return token_table(spark, sf_dir).select("vec_id", F.round(T.entropy("e"), 5).alias("entropy"))


def l38_logprob_at(spark, sf_dir):
    return token_table(spark, sf_dir).select("vec_id", F.round(T.log_softmax_at("e", (F.col("vec_id") % 64).cast("int")), 5).alias("logprob"))


def l30_batch_logps(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("labels", F.transform(T.MASK, lambda m: F.when(m == 0, -100).otherwise(1)))
    return t.select("vec_id", F.round(T.batch_logps(T.NEW, "labels"), 5).alias("total"), F.round(T.batch_logps(T.NEW, "labels", True), 5).alias("mean"))


def l33_topk_kl(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumns({"p": T.normalized_logps(T.OLD), "q": T.normalized_logps(T.NEW)})
    return t.select("vec_id", F.round(T.topk_kl("p", "q"), 5).alias("kl"))


def l31_sppo(spark, sf_dir):
    return rounded(T.sppo_loss(token_table(spark, sf_dir).withColumn("r", F.col("label").cast("double")), "r"), 3)


def l32_flow(spark, sf_dir):
    return rounded(T.flow_loss(token_table(spark, sf_dir).withColumns({"r": F.col("label") / 10.0, "z": F.lit(0.5)}), "r", "z"), 3)


def l35_sft(spark, sf_dir):
    return rounded(T.sft_loss(token_table(spark, sf_dir)))


def w01_gae(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("gae", T.gae(T.ADV, T.VALUES, gamma=0.9, lam=0.8))
    return t.select("vec_id", F.posexplode("gae").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("advantage"))


def w09_discounted_returns(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("ret", T.discounted_returns(T.ADV, gamma=0.9))
    return t.select("vec_id", F.posexplode("ret").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("ret"))


def w10_reverse_cumsum(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("r", T.each([T.ADV, T.MASK], lambda t: t[T.ADV] * t[T.MASK])).withColumn("ret", T.discounted_returns("r", gamma=1.0, reset=False))
    return t.select("vec_id", F.posexplode("ret").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("ret"))


def w18_position_ids(spark, sf_dir):
    return token_table(spark, sf_dir).select("vec_id", F.array_join(T.position_ids(T.MASK), ",").alias("positions"))


def r11_eos_mask(spark, sf_dir):
    t = token_table(spark, sf_dir).withColumn("ids", F.transform("e", lambda x: F.floor(F.abs(x) * 20).cast("long")))
    return t.select("vec_id", F.aggregate(T.eos_mask("ids", [1, 3]), F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


def x08_overlong_penalty(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.round(T.overlong_penalty(F.col("n_chars"), 4000, 1000), 6).alias("penalty"))


def l29_dpo(spark, sf_dir):
    t = token_table(spark, sf_dir)
    x = [F.get(F.col(c), F.lit(i)) for c, i in ((T.OLD, 0), (T.OLD, 1), (T.REF, 0), (T.REF, 1))]
    return t.select("vec_id", *[F.round(T.dpo_loss(*x, beta=0.5, smoothing=0.1, kind=k), 6).alias(k) for k in ("sigmoid", "ipo")])


def l34_bce(spark, sf_dir):
    return token_table(spark, sf_dir).select("vec_id", F.round(T.bce_loss(T.masked_sum(T.ADV), (F.col("label") % 2).cast("double"), 0.05), 6).alias("loss"))


def _rollouts(spark, sf_dir) -> DataFrame:
    """The token table where every eleventh row has no token."""
    return token_table(spark, sf_dir).withColumn(T.MASK, F.transform(T.MASK, lambda m: F.when(F.col("vec_id") % 11 == 0, 0).otherwise(m).cast("int")))


def _corrections(level: str, reject: str):
    def query(spark, sf_dir):
        return rounded(T.correction_metrics(_rollouts(spark, sf_dir), weights=level, threshold=1.06, reject=reject, upper=1.08, lower=0.95, veto=0.91, normalize=True), 4)

    return query


def _corrected(reject: str, veto: float | None = None):
    """What a correction leaves of every row: tokens, and the sum of their weights."""

    def query(spark, sf_dir):
        t = T.corrected(_rollouts(spark, sf_dir), weights="token", threshold=1.06, reject=reject, upper=1.08, lower=0.95, veto=veto)
        return t.select("vec_id", F.aggregate(T.MASK, F.lit(0), lambda a, x: a + x).cast("long").alias("n"), F.round(T.masked_sum("rollout_is_weights"), 5).alias("weight"))

    return query


def l08_corrected_loss(spark, sf_dir):
    t = _rollouts(spark, sf_dir)
    one = T.rollout_corrected_loss(t, weights="token", threshold=1.5, reject="geometric", upper=1.05, lower=0.95)
    two = T.get_policy_loss("rollout_correction")(t, "seq-mean-token-sum", weights="sequence", threshold=1.2, veto=0.5)
    return rounded(one).crossJoin(rounded(two).withColumnsRenamed({"pg_loss": "seq_loss", "ppo_kl": "seq_kl"}))


def l28_bypassed(spark, sf_dir):
    """Bypass with either loss: the rollout's log-probabilities take the place of the old ones."""
    t, name = T.bypassed(token_table(spark, sf_dir))
    u, other = T.bypassed(token_table(spark, sf_dir), policy_gradient=True)
    return rounded(T.get_policy_loss(name)(t).select(F.col("pg_loss").alias("ppo_loss"), F.col("ppo_kl").alias("ppo_kl"))).crossJoin(rounded(T.get_policy_loss(other)(u).select("pg_loss")))


def w01_gae_returns(spark, sf_dir):
    t = T.gae_batch(token_table(spark, sf_dir).drop(T.RETURNS).withColumn("r", F.col(T.ADV)).drop(T.ADV), "r", T.VALUES, gamma=0.9, lam=0.8)
    return t.select("vec_id", F.posexplode(F.arrays_zip(T.ADV, T.RETURNS)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x.advantages", 5).alias("advantage"), F.round("x.returns", 5).alias("ret"))


def l11_entropy_loss(spark, sf_dir):
    """Entropies of softmax(|e_i|, 0) over the tokens, reduced by each mode."""
    t = token_table(spark, sf_dir).withColumn("entropy", F.transform("e", lambda x: T.entropy(F.array(F.abs(x), F.lit(0.0)))))
    s = t.select(T.sums(["entropy"], v=lambda x: x["entropy"]).alias("s"))
    return rounded(s.agg(*[T.aggregate_loss("s", "v", m, WIDTH).alias(m.replace("-", "_")) for m in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean")]))


def l36_combined_loss(spark, sf_dir):
    return rounded(T.combined_loss(token_table(spark, sf_dir).withColumn("entropy", F.transform("e", lambda x: F.abs(x))), "entropy", entropy_coef=0.01, kl_coef=0.2, kind="low_var_kl"))


def l42_response_logprobs(spark, sf_dir):
    """Log-probabilities of each position's label among three logits."""
    t = token_table(spark, sf_dir).withColumns({"logits": F.transform("e", lambda x: F.array(x, -x, F.lit(0.5))), "labels": F.transform("e", lambda x: F.when(x > 0.2, 0).when(x < -0.2, 1).otherwise(2))})
    return t.select("vec_id", F.posexplode(T.token_logprobs("logits", "labels")).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("logprob"))


def l44_kept_logits(spark, sf_dir):
    """Scaled by temperature, then the top 10, then the smallest set that holds 0.7 of the mass; how many logits are left."""
    t = token_table(spark, sf_dir).select("vec_id", T.scaled_logits("e", 0.25).alias("z"))
    t = t.select("vec_id", T.top_k_logits("z", 10).alias("z")).select("vec_id", T.top_p_logits("z", 0.7).alias("z"))
    return t.select("vec_id", F.size(F.filter("z", lambda x: x.isNotNull())).alias("kept"), F.round(F.aggregate(F.filter("z", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def l17_kl_controllers(spark, sf_dir):
    """The adaptive and the fixed coefficient after the events, as batches in order of their number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 200").alias("step")).agg(F.avg("value").alias("kl"), F.count("*").alias("n"))
    return T.controlled(e, "step", "kl", "n", T.kl_controller("adaptive", 0.2, 50.0, 1_000.0)).withColumn("coef", F.round("coef", 8)).crossJoin(spark.createDataFrame([(T.kl_controller("fixed", 0.3).update(9.0, 5),)], "fixed double"))


def a04_mean_max_min_std(spark, sf_dir):
    t = token_table(spark, sf_dir).select(F.explode(T.ADV).alias("x"))
    return rounded(t.agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_samp("x").alias("std")))


def w13_mixed(spark, sf_dir):
    """Token rewards and accuracies of four rows a prompt, a third and two thirds."""
    from .advantages import mixed_leave_one_out

    t = token_table(spark, sf_dir).drop(T.RETURNS).withColumnRenamed(T.ADV, "rewards").withColumns({"acc": (F.col("label") % 2).cast("double"), "length": F.col("vec_id") % 55 + 10})
    done = mixed_leave_one_out(t, "vec_id", 4, rewards="rewards", accuracy="acc", reward_share=1 / 3, accuracy_share=2 / 3)
    pairs = F.arrays_zip(F.col("advantages").alias("a"), F.col("returns").alias("r"))
    return done.select("vec_id", F.posexplode(pairs).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x.a", 5).alias("advantage"), F.round("x.r", 5).alias("ret"))


def _estimated(name: str, **options):
    """Advantages and returns of the token table by an estimator; rewards are the advantages' column."""

    def query(spark, sf_dir):
        from .advantages import Batch, token_advantages

        t = token_table(spark, sf_dir).drop(T.RETURNS).withColumnRenamed(T.ADV, "rewards").withColumn("baseline", (F.col("vec_id") % 7) / 10)
        done = token_advantages(t, name, rewards="rewards", batch=Batch(score="score", group="label", order=("vec_id",)), **options)
        pairs = F.arrays_zip(F.col(T.ADV).alias("a"), F.col("returns").alias("r"))
        return done.select("vec_id", F.posexplode(pairs).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x.a", 5).alias("advantage"), F.round("x.r", 5).alias("ret"))

    return query


QUERIES = {
    f.__name__: f
    for f in (a01_masked_mean, a03_masked_var, a06_loss_modes, w19_whiten, l10_value_loss, l12_divergences, l16_kl_penalty, l16_batch_kl, l20_token_weights, l20_sequence_weights, l21_rejection, l25_weight_metrics, l26_off_policy, l13_entropy, l38_logprob_at, l30_batch_logps, l33_topk_kl, l31_sppo, l32_flow, l35_sft, w01_gae, w09_discounted_returns, w10_reverse_cumsum, w18_position_ids, r11_eos_mask, x08_overlong_penalty, l29_dpo, l34_bce, l08_corrected_loss, l28_bypassed, w01_gae_returns, l11_entropy_loss, l36_combined_loss, l42_response_logprobs, l44_kept_logits, l17_kl_controllers, a04_mean_max_min_std)
}
QUERIES |= {"l01_ppo_loss": _loss("vanilla"), "l03_gspo_loss": _loss("gspo"), "l04_gpg_loss": _loss("gpg"), "l07_geo_mean_loss": _loss("geo_mean"), "l06_kl_cov_loss": _loss("kl_cov", ratio=0.01), "l05_clip_cov_loss": _loss("clip_cov", ratio=0.01)}

QUERIES |= {f"l24_{level}_{reject}_metrics": _corrections(level, reject) for level, reject in (("token", "token"), ("sequence", "sequence"), ("token", "geometric"))}
QUERIES |= {"w13_mixed": w13_mixed}
QUERIES |= {"w12_reinforce_plus_plus": _estimated("reinforce_plus_plus", gamma=0.9), "w12_remax": _estimated("remax", baselines="baseline"), "w12_group_relative": _estimated("grpo")}
QUERIES |= {"l22_token_rejected": _corrected("token"), "l22_geometric_rejected": _corrected("geometric"), "l22_sequence_vetoed": _corrected("sequence", 0.91)}

_TOK = """WITH base AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
tok AS (SELECT vec_id, label, i AS pos, e[i + 1] AS e, -abs(e[i + 1]) AS old, -abs(e[64 - i]) AS new, e[(i + 1) % 64 + 1] AS adv, -abs(e[i + 1] + 0.1) AS ref,
  e[i + 1] / 2 AS val, e[i + 1] / 2 + e[(i + 1) % 64 + 1] / 2 AS ret, -e[i + 1] / 2 AS vp, CASE WHEN i < 10 + vec_id % 55 AND i % 7 <> 3 THEN 1 ELSE 0 END AS m FROM base, range(64) r(i))"""
_N = "(sum(m) + 1e-8)"


def _row(expr: str) -> str:
    return f"sum({expr}) FILTER (m = 1)"


_CLIP = "greatest(-adv * exp(least(greatest(new - old, -20), 20)), -adv * least(greatest(exp(least(greatest(new - old, -20), 20)), 0.8), 1.2))"
_PAR = "clip AS (SELECT *, -adv * exp(least(greatest(new - old, -20), 20)) AS one, -adv * least(greatest(exp(least(greatest(new - old, -20), 20)), 0.8), 1.2) AS two, -adv * 3.0 AS three FROM tok)"
_ROL = _TOK.replace("THEN 1 ELSE 0 END AS m FROM base", "AND vec_id % 11 <> 0 THEN 1 ELSE 0 END AS m FROM base")
#: Row by row over lists: a self-join of all tokens would not end.
_W19 = """WITH base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
tok AS (SELECT vec_id, list_transform(range(64), lambda i: e[(i + 1) % 64 + 1]) AS a, list_transform(range(64), lambda i: CASE WHEN i < 10 + vec_id % 55 AND i % 7 <> 3 THEN 1 ELSE 0 END) AS m FROM base),
r AS (SELECT list_sum(m) AS n, list_sum(list_transform(list_zip(a, m), lambda p: p[1] * p[2])) AS s, list_sum(list_transform(list_zip(a, m), lambda p: p[1] * p[1] * p[2])) AS q FROM tok),
mu AS (SELECT sum(s) / (sum(n) + 1e-8) AS mu, (sum(q) / sum(n) - (sum(s) / sum(n)) ^ 2) * sum(n) / (sum(n) - 1) AS var FROM r)
SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(a, lambda x: round((x - mu) / sqrt(var + 1e-8), 5))) AS white FROM tok, mu"""
#: A fold over each row's tokens from the last one: the next masked value and the advantage so far.
_W01 = """WITH base AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT vec_id, list_transform(range(63, -1, -1), lambda i: {'a': e[(i + 1) % 64 + 1], 'v': e[i + 1] / 2, 'm': CASE WHEN i < 10 + vec_id % 55 AND i % 7 <> 3 THEN 1 ELSE 0 END, 'nv': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'out': []::DOUBLE[]}) AS l FROM base),
f AS (SELECT vec_id, list_reverse(list_transform(l, lambda x: x.v)) AS v, list_reverse(list_transform(l, lambda x: x.m)) AS m,
  list_reduce(list_concat([{'a': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'm': 0, 'nv': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'out': []::DOUBLE[]}], l), lambda s, x: {'a': x.a, 'v': x.v, 'm': x.m, 'nv': CASE WHEN x.m = 1 THEN x.v ELSE s.nv END,
    'g': CASE WHEN x.m = 1 THEN x.a + 0.9 * s.nv - x.v + 0.72 * s.g ELSE s.g END, 'out': list_prepend(CASE WHEN x.m = 1 THEN x.a + 0.9 * s.nv - x.v + 0.72 * s.g ELSE s.g END, s.out)}).out AS g FROM l),
r AS (SELECT list_sum(m) AS n, list_sum(list_transform(list_zip(g, m), lambda p: p[1] * p[2])) AS s, list_sum(list_transform(list_zip(g, m), lambda p: p[1] * p[1] * p[2])) AS q FROM f),
mu AS (SELECT sum(s) / (sum(n) + 1e-8) AS mu, (sum(q) / sum(n) - (sum(s) / sum(n)) ^ 2) * sum(n) / (sum(n) - 1) AS var FROM r)
SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(g, lambda x: round((x - mu) / sqrt(var + 1e-8), 5))) AS advantage, unnest(list_transform(list_zip(g, v), lambda p: round(p[1] + p[2], 5))) AS ret FROM f, mu"""


def _metric_sql(level: str, reject: str) -> str:
    """The metrics of a correction, from token sums (t), rows (s) and the off-policy query."""

    def stats(kind: str, prefix: str, hi: str, lo: str) -> str:
        c = f"least(greatest(w, {lo}), {hi})"
        seq = "sw" if kind == "token" else {"sequence": "ws", "geometric": "wg"}[kind] + " * n / (n + 1e-8)"
        if kind == "token":
            own = {"max": "(SELECT max(w) FILTER (m = 1) FROM t)", "min": "(SELECT min(w) FILTER (m = 1) FROM t)", "ratio_fraction_high": f"(SELECT sum((w > {hi})::INT * m) / {_N} FROM t)", "ratio_fraction_low": f"(SELECT sum((w < {lo})::INT * m) / {_N} FROM t)", "mean": f"(SELECT sum(w * m) / {_N} FROM t)", "c": f"(SELECT sum({c} * m) / {_N} FROM t)", "q": f"(SELECT sum({c} * {c} * m) / {_N} FROM t)"}
        else:
            x, w = {"sequence": ("d", "ws"), "geometric": ("d / (n + 1e-8)", "wg")}[kind]
            c = f"least(greatest({w}, {lo}), {hi})"
            own = {"max": f"exp(least(max({x}), 20))", "min": f"exp(min({x}))", "ratio_fraction_high": f"avg(({x} > ln({hi}))::INT)", "ratio_fraction_low": f"avg(({x} < ln({lo}))::INT)", "mean": f"sum({w} * n) / (sum(n) + 1e-8)", "c": f"(sum({c} * n) / (sum(n) + 1e-8))", "q": f"(sum({c} * {c} * n) / (sum(n) + 1e-8))"}
        cc, qq = own.pop("c"), own.pop("q")
        own |= {"std": f"sqrt(greatest({qq} - {cc} * {cc}, 0))", "eff_sample_size": f"({cc} + 1e-8) ^ 2 / {qq}", "seq_mean": f"avg({seq})", "seq_std": f"stddev_samp({seq})", "seq_max": f"max({seq})", "seq_min": f"min({seq})", "seq_max_deviation": f"max(abs({seq} - 1))", "seq_fraction_high": f"avg(({seq} > {hi})::INT)", "seq_fraction_low": f"avg(({seq} < {lo})::INT)"}
        return ", ".join(f"round({v}, 4) AS {prefix}_{k}" for k, v in own.items())

    factor = f"(SELECT sum(least(w * m, 1.06)) / {_N} FROM t)" if level == "token" else "avg(least(ws, 1.06) * n / (n + 1e-8)) FILTER (n > 0)"
    gone = {"token": ("sum(tok_out) / (sum(n) + 1e-8)", "avg((tok_out > 0)::INT)"), "sequence": ("sum(CASE WHEN ws BETWEEN 0.95 AND 1.08 THEN 0 ELSE n END) / (sum(n) + 1e-8)", "avg((NOT ws BETWEEN 0.95 AND 1.08)::INT)"), "geometric": ("sum(CASE WHEN wg BETWEEN 0.95 AND 1.08 THEN 0 ELSE n END) / (sum(n) + 1e-8)", "avg((NOT wg BETWEEN 0.95 AND 1.08)::INT)")}[reject]
    return f"""{_ROL}, t AS (SELECT *, exp(old - ref) AS w FROM tok),
    s AS (SELECT vec_id, sum(m) AS n, sum((old - ref) * m) AS d, sum(old * m) / {_N} AS a, sum(ref * m) / {_N} AS b, sum(w * m) / {_N} AS sw, exp(least(greatest(sum((old - ref) * m), -20), 20)) AS ws, exp(sum((old - ref) * m) / {_N}) AS wg, sum((NOT w BETWEEN 0.95 AND 1.08)::INT * m) AS tok_out, sum((w < 0.91)::INT * m) AS bad FROM t GROUP BY 1),
    g AS (SELECT sum((ref - old) * m) / {_N} AS kl, sum((exp(old - ref) - (old - ref) - 1) * m) / {_N} AS k3, sum(exp(2 * (old - ref)) * m) / {_N} - 1 AS chi FROM tok)
    SELECT sum(n)::DOUBLE AS n_tokens, {stats(level, 'rollout_is', '1.06', '(1 / 1.06)')}, round({factor}, 4) AS rollout_is_batch_norm_factor, {stats(reject, 'rollout_rs', '1.08', '0.95')}, round({gone[0]}, 4) AS rollout_rs_masked_fraction, round({gone[1]}, 4) AS rollout_rs_seq_masked_fraction, round(avg((bad > 0)::INT), 4) AS rollout_is_veto_fraction, round(sum(bad) / (sum(n) + 1e-8), 4) AS rollout_is_catastrophic_token_fraction,
    round(avg(exp(-a)), 4) AS training_ppl, round(avg(-a), 4) AS training_log_ppl, round(any_value(kl), 4) AS kl, round(any_value(k3), 4) AS k3_kl, round(avg(exp(-b)), 4) AS rollout_ppl, round(avg(-b), 4) AS rollout_log_ppl, round(avg(b - a), 4) AS log_ppl_diff, round(avg(abs(b - a)), 4) AS log_ppl_abs_diff, round(max(b - a), 4) AS log_ppl_diff_max, round(min(b - a), 4) AS log_ppl_diff_min, round(avg(exp(b - a)), 4) AS ppl_ratio, round(any_value(chi), 4) AS chi2_token, round(avg(exp(2 * least(greatest(d, -20), 20))) - 1, 4) AS chi2_seq FROM s, g"""


def _rejected_sql(ok: str) -> str:
    return f"{_ROL}, s AS (SELECT vec_id, sum((old - ref) * m) AS d, sum(m) AS n, max((exp(old - ref) < 0.91)::INT * m) AS bad FROM tok GROUP BY 1), k AS (SELECT vec_id, m * ({ok})::INT AS k, least(exp(old - ref) * m, 1.06) AS w FROM tok JOIN s USING (vec_id)) SELECT vec_id, CAST(sum(k) AS BIGINT) AS n, round(sum(w * k), 5) AS weight FROM k GROUP BY 1"


ORACLES = {
    "w12_reinforce_plus_plus": f"{_TOK}, g AS (SELECT *, coalesce(sum(1 - m) OVER (PARTITION BY vec_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM tok), r AS (SELECT vec_id, pos, m, sum(adv * 0.9 ^ pos) OVER (PARTITION BY vec_id, g ORDER BY pos DESC) / 0.9 ^ pos AS ret FROM g), mu AS (SELECT sum(ret * m) / {_N} AS mu, var_samp(ret) FILTER (m = 1) AS v FROM r) SELECT vec_id, pos, round((ret - mu) / sqrt(v + 1e-8) * m, 5) AS advantage, round(ret, 5) AS ret FROM r, mu",
    "w13_mixed": f"{_TOK}, b AS (SELECT vec_id, vec_id // 4 AS k, sum(adv * m) / sum(m) AS mean, any_value(label) % 2 AS acc FROM tok GROUP BY 1, 2), w AS (SELECT vec_id, sum(mean) OVER (PARTITION BY k) / 3 AS base, acc * (4 / 3) - sum(acc) OVER (PARTITION BY k) / 3 AS own FROM b), t AS (SELECT tok.vec_id, pos, m, ((adv * (4 / 3) - base) * m / 3 + CASE WHEN pos = vec_id % 55 + 9 THEN own * 2 / 3 ELSE 0 END) * m AS x FROM tok JOIN w USING (vec_id)), r AS (SELECT vec_id, pos, m, sum(x) OVER (PARTITION BY vec_id ORDER BY pos DESC) AS ret FROM t), mu AS (SELECT sum(ret * m) / {_N} AS mu, var_samp(ret) FILTER (m = 1) AS v FROM r) SELECT vec_id, pos, round((ret - mu) / sqrt(v + 1e-8), 5) AS advantage, round(ret, 5) AS ret FROM r, mu",
    "w12_remax": f"{_TOK}, r AS (SELECT vec_id, pos, m, sum(adv * m) OVER (PARTITION BY vec_id ORDER BY pos DESC) AS ret FROM tok) SELECT vec_id, pos, round(ret - vec_id % 7 / 10 * m, 5) AS advantage, round(ret, 5) AS ret FROM r",
    "w12_group_relative": f"{_TOK}, s AS (SELECT vec_id, any_value(label) AS label, sum(adv) AS s FROM tok GROUP BY 1), a AS (SELECT vec_id, (s - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(s) OVER w END) / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(s) OVER w END + 1e-6) AS a FROM s WINDOW w AS (PARTITION BY label)) SELECT vec_id, pos, round(a * m, 5) AS advantage, round(a * m, 5) AS ret FROM tok JOIN a USING (vec_id)",
    "l22_token_rejected": _rejected_sql("exp(old - ref) BETWEEN 0.95 AND 1.08"),
    "l22_geometric_rejected": _rejected_sql("exp(d / (n + 1e-8)) BETWEEN 0.95 AND 1.08"),
    "l22_sequence_vetoed": _rejected_sql("exp(least(greatest(d, -20), 20)) BETWEEN 0.95 AND 1.08 AND bad = 0"),
    **{f"l24_{level}_{reject}_metrics": _metric_sql(level, reject) for level, reject in (("token", "token"), ("sequence", "sequence"), ("token", "geometric"))},
    "a01_masked_mean": f"{_TOK} SELECT vec_id, round(sum(adv * m), 5) AS total, round(sum(adv * m) / {_N}, 5) AS mean FROM tok GROUP BY vec_id",
    "a03_masked_var": f"{_TOK}, mu AS (SELECT sum(adv * m) / {_N} AS mu FROM tok) SELECT CAST(sum(m) AS DOUBLE) AS n, round(any_value(mu), 5) AS mean, round(sum((adv - mu) ^ 2 * m) / {_N} * sum(m) / (sum(m) - 1), 5) AS var FROM tok, mu",
    "a06_loss_modes": f"{_TOK}, s AS (SELECT vec_id, sum(adv * adv * m) AS l, sum(m) AS n FROM tok GROUP BY vec_id) SELECT round(sum(l) / sum(n), 5) AS token_mean, round(avg(l) FILTER (n > 0), 5) AS seq_mean_token_sum, round(avg(l / (n + 1e-8)) FILTER (n > 0), 5) AS seq_mean_token_mean, round(sum(l) / 64, 5) AS seq_mean_token_sum_norm FROM s",
    "w19_whiten": _W19,
    "l01_ppo_loss": f"{_TOK}, {_PAR} SELECT round(sum(CASE WHEN adv < 0 THEN least(three, greatest(one, two)) ELSE greatest(one, two) END * m) / sum(m), 5) AS pg_loss, round(sum((two > one)::INT * m) / {_N}, 5) AS pg_clipfrac, round(sum((old - new) * m) / {_N}, 5) AS ppo_kl, round(sum((greatest(one, two) > three AND adv < 0)::INT * m) / {_N}, 5) AS pg_clipfrac_lower FROM clip",
    "l03_gspo_loss": f"{_TOK}, q AS (SELECT vec_id, exp(least(sum((new - old) * m) / greatest(sum(m), 1), 10)) AS ratio FROM tok GROUP BY 1), c AS (SELECT t.*, -adv * ratio AS one, -adv * least(greatest(ratio, 0.8), 1.2) AS two FROM tok t JOIN q USING (vec_id)), s AS (SELECT vec_id, sum(greatest(one, two) * m) / {_N} AS l, sum(m) AS n FROM c GROUP BY 1) SELECT (SELECT round(avg(l) FILTER (n > 0), 5) FROM s) AS pg_loss, round(sum((two > one)::INT * m) / {_N}, 5) AS pg_clipfrac, round(sum((old - new) * m) / {_N}, 5) AS ppo_kl, 0.0::DOUBLE AS pg_clipfrac_lower FROM c",
    "l04_gpg_loss": f"{_TOK} SELECT round(sum(-new * adv * m) / sum(m), 5) AS pg_loss FROM tok",
    "l07_geo_mean_loss": f"{_TOK}, c AS (SELECT *, new - old AS d, least(greatest(new - old, -0.2), 0.2) AS k FROM tok), s AS (SELECT vec_id, sum(sign(adv) * least(sign(adv) * d, sign(adv) * k) * m) / {_N} AS d, sum(adv * m) / {_N} AS a FROM c GROUP BY 1) SELECT (SELECT round(avg(-a * exp(d)), 5) FROM s) AS pg_loss, round(sum((d <> k AND adv > 0)::INT * m) / {_N}, 5) AS pg_clipfrac, round(sum(-d * m) / {_N}, 5) AS ppo_kl, round(sum((d <> k AND adv < 0)::INT * m) / {_N}, 5) AS pg_clipfrac_lower FROM c",
    "l06_kl_cov_loss": f"{_TOK}, mu AS (SELECT sum(adv * m) / {_N} AS ma, sum(new * m) / {_N} AS ml, CAST(greatest(1, floor(sum(m) * 0.01)) AS BIGINT) AS k FROM tok), r AS (SELECT t.*, k, row_number() OVER (ORDER BY (adv - ma) * (new - ml) DESC, vec_id, pos) AS rk FROM tok t, mu WHERE m = 1) SELECT round(sum(-adv * exp(new - old) + CASE WHEN rk <= k THEN abs(new - old) ELSE 0 END) / count(*), 5) AS pg_loss FROM r",
    "l10_value_loss": f"{_TOK}, c AS (SELECT *, (vp - ret) ^ 2 AS one, (least(greatest(vp, val - 0.2), val + 0.2) - ret) ^ 2 AS two FROM tok) SELECT round(0.5 * sum(greatest(one, two) * m) / sum(m), 5) AS vf_loss, round(sum((two > one)::INT * m) / {_N}, 5) AS vf_clipfrac FROM c",
    "l12_divergences": f"{_TOK} SELECT round(sum((old - ref) * m) / {_N}, 5) AS k1, round(sum(abs(old - ref) * m) / {_N}, 5) AS abs, round(sum(0.5 * (old - ref) ^ 2 * m) / {_N}, 5) AS k2, round(sum((exp(ref - old) - (ref - old) - 1) * m) / {_N}, 5) AS k3 FROM tok",
    "l16_kl_penalty": f"{_TOK} SELECT vec_id, round(sum(adv - 0.2 * (old - ref) * m), 5) AS total FROM tok GROUP BY 1",
    "l16_batch_kl": f"{_TOK}, s AS (SELECT vec_id, sum((old - ref) * m) / {_N} AS k FROM tok GROUP BY 1) SELECT round(avg(k), 5) AS kl, count(*) AS rows FROM s",
    "l20_token_weights": f"{_TOK} SELECT vec_id, round(sum(least(exp(old - ref) * m, 1.05)), 5) AS total FROM tok GROUP BY 1",
    "l20_sequence_weights": f"{_TOK}, s AS (SELECT vec_id, least(exp(least(greatest(sum((old - ref) * m), -20), 20)), 2.0) AS w, sum(m) AS n FROM tok GROUP BY 1), mu AS (SELECT avg(w * n / (n + 1e-8)) AS mu FROM s) SELECT vec_id, round(w / mu, 5) AS weight FROM s, mu",
    "l21_rejection": f"{_TOK}, s AS (SELECT vec_id, sum((old - ref) * m) AS d, sum(m) AS n, sum(m) FILTER (exp(old - ref) BETWEEN 1 / 1.08 AND 1.08) AS token, bool_or(exp(old - ref) < 0.91 AND m = 1) AS bad FROM tok GROUP BY 1) SELECT vec_id, CAST(coalesce(token, 0) AS BIGINT) AS token, CAST(CASE WHEN exp(d) BETWEEN 1 / 1.08 AND 1.08 THEN n ELSE 0 END AS BIGINT) AS sequence, CAST(CASE WHEN exp(d / (n + 1e-8)) BETWEEN 1 / 1.08 AND 1.08 THEN n ELSE 0 END AS BIGINT) AS geometric, CAST(CASE WHEN bad THEN 0 ELSE coalesce(token, 0) END AS BIGINT) AS vetoed FROM s",
    "l25_weight_metrics": f"{_TOK}, w AS (SELECT vec_id, m, exp(old - ref) AS w, least(greatest(exp(old - ref), 1 / 1.08), 1.08) AS c FROM tok), s AS (SELECT vec_id, sum(w * m) / {_N} AS sm FROM w GROUP BY 1), g AS (SELECT sum(w * m) / {_N} AS mean, max(w) FILTER (m = 1) AS max, min(w) FILTER (m = 1) AS min, sum((w > 1.08)::INT * m) / {_N} AS fh, sum((w < 1 / 1.08)::INT * m) / {_N} AS fl, sum(c * m) / {_N} AS mc, sum(c * c * m) / {_N} AS mq FROM w) SELECT round(mean, 5) AS mean, round(max, 5) AS max, round(min, 5) AS min, round(fh, 5) AS fraction_high, round(fl, 5) AS fraction_low, round(sqrt(greatest(mq - mc * mc, 0)), 5) AS std, round((mc + 1e-8) ^ 2 / mq, 5) AS eff_sample_size, (SELECT round(avg(sm), 5) FROM s) AS seq_mean, (SELECT round(stddev_samp(sm), 5) FROM s) AS seq_std, (SELECT round(max(sm), 5) FROM s) AS seq_max, (SELECT round(min(sm), 5) FROM s) AS seq_min, (SELECT round(max(abs(sm - 1)), 5) FROM s) AS seq_max_deviation, (SELECT round(avg((sm > 1.08)::INT), 5) FROM s) AS seq_fraction_high, (SELECT round(avg((sm < 1 / 1.08)::INT), 5) FROM s) AS seq_fraction_low FROM g",
    "l26_off_policy": f"{_TOK}, s AS (SELECT vec_id, sum(old * m) / {_N} AS a, sum(ref * m) / {_N} AS b, sum((old - ref) * m) AS d FROM tok GROUP BY 1), g AS (SELECT sum((ref - old) * m) / {_N} AS kl, sum((exp(old - ref) - (old - ref) - 1) * m) / {_N} AS k3, sum(exp(2 * (old - ref)) * m) / {_N} - 1 AS chi FROM tok) SELECT round(avg(exp(-a)), 4) AS training_ppl, round(avg(-a), 4) AS training_log_ppl, round(any_value(kl), 4) AS kl, round(any_value(k3), 4) AS k3_kl, round(avg(exp(-b)), 4) AS rollout_ppl, round(avg(-b), 4) AS rollout_log_ppl, round(avg(b - a), 4) AS log_ppl_diff, round(avg(abs(b - a)), 4) AS log_ppl_abs_diff, round(max(b - a), 4) AS log_ppl_diff_max, round(min(b - a), 4) AS log_ppl_diff_min, round(avg(exp(b - a)), 4) AS ppl_ratio, round(any_value(chi), 4) AS chi2_token, round(avg(exp(2 * least(greatest(d, -20), 20))) - 1, 4) AS chi2_seq FROM s, g",
    "l13_entropy": f"{_TOK}, z AS (SELECT vec_id, max(e) AS top FROM tok GROUP BY 1) SELECT vec_id, round(any_value(top) + ln(sum(exp(e - top))) - sum(exp(e - top) * e) / sum(exp(e - top)), 5) AS entropy FROM tok JOIN z USING (vec_id) GROUP BY vec_id",
    "l38_logprob_at": f"{_TOK} SELECT vec_id, round(max(e) FILTER (pos = vec_id % 64) - ln(sum(exp(e))), 5) AS logprob FROM tok GROUP BY vec_id",
    "l30_batch_logps": f"{_TOK} SELECT vec_id, round(sum(new * m), 5) AS total, round(sum(new * m) / sum(m), 5) AS mean FROM tok GROUP BY vec_id",
    "l33_topk_kl": f"{_TOK}, z AS (SELECT vec_id, ln(sum(exp(old))) AS zo, ln(sum(exp(new))) AS zn FROM tok GROUP BY 1) SELECT vec_id, round(sum(exp(old - zo) * ((old - zo) - (new - zn))), 5) AS kl FROM tok JOIN z USING (vec_id) GROUP BY vec_id",
    "l31_sppo": f"{_TOK}, s AS (SELECT vec_id, sum((new - old) * m) AS d, any_value(label) AS r FROM tok GROUP BY 1) SELECT round(avg((d - r) ^ 2), 3) AS loss FROM s",
    "l32_flow": f"{_TOK}, s AS (SELECT vec_id, sum((new - old) * m) AS d, sum(new * m) / {_N} AS p, sum(ref * m) / {_N} AS q, any_value(label) / 10.0 AS r FROM tok GROUP BY 1) SELECT round(avg(least(exp(d), 10) * (0.5 + p - 15 * r - q) ^ 2), 3) AS loss FROM s",
    "l35_sft": f"{_TOK} SELECT round(-sum(new * m) / sum(m), 5) AS loss FROM tok",
    "l05_clip_cov_loss": f"{_TOK}, mu AS (SELECT sum(adv * m) / {_N} AS ma, sum(new * m) / {_N} AS ml, CAST(greatest(1, floor(sum(m) * 0.01)) AS BIGINT) AS k FROM tok), c AS (SELECT t.*, k, (adv - ma) * (new - ml) AS cov, -adv * exp(new - old) AS one, -adv * least(greatest(exp(new - old), 0.8), 1.2) AS two, (((vec_id * 48271 + pos * 69621 + 12345) % 2147483647) * 48271) % 2147483647 AS draw FROM tok t, mu WHERE m = 1), b AS (SELECT vec_id, pos, row_number() OVER (ORDER BY draw, vec_id, pos) AS rk FROM c WHERE cov > 1 AND cov < 5 AND NOT two > one) SELECT round(sum(CASE WHEN rk <= k THEN 0 ELSE greatest(one, two) END) / count(*), 5) AS pg_loss FROM c LEFT JOIN b USING (vec_id, pos)",
    "l08_corrected_loss": f"{_ROL}, s AS (SELECT vec_id, sum((new - old) * m) AS d, sum(m) AS n FROM tok GROUP BY 1), g AS (SELECT t.*, least(exp(least(greatest(new - old, -20), 20)) * m, 1.5) AS w, CASE WHEN exp(least(greatest(d / (n + 1e-8), -20), 20)) BETWEEN 0.95 AND 1.05 THEN m ELSE 0 END AS gm, least(exp(least(greatest(d, -20), 20)) * m, 1.2) AS sw FROM tok t JOIN s USING (vec_id)), q AS (SELECT vec_id, sum(-adv * new * sw * m) AS l, sum(m) AS n FROM g GROUP BY 1) SELECT round(sum(-adv * new * w * gm) / sum(gm), 5) AS pg_loss, round(sum((old - new) * gm) / (sum(gm) + 1e-8), 5) AS ppo_kl, (SELECT round(avg(l) FILTER (n > 0), 5) FROM q) AS seq_loss, round(sum((old - new) * m) / {_N}, 5) AS seq_kl FROM g",
    "l28_bypassed": f"{_TOK}, c AS (SELECT *, -adv * exp(least(greatest(new - ref, -20), 20)) AS one, -adv * least(greatest(exp(least(greatest(new - ref, -20), 20)), 0.8), 1.2) AS two, -adv * 3.0 AS three FROM tok) SELECT round(sum(CASE WHEN adv < 0 THEN least(three, greatest(one, two)) ELSE greatest(one, two) END * m) / sum(m), 5) AS ppo_loss, round(sum((ref - new) * m) / {_N}, 5) AS ppo_kl, round(sum(-adv * new * m) / sum(m), 5) AS pg_loss FROM c",
    "w01_gae_returns": _W01,
    "l11_entropy_loss": f"{_TOK}, h AS (SELECT vec_id, m, ln(exp(abs(e)) + 1) - abs(e) * exp(abs(e)) / (exp(abs(e)) + 1) AS h FROM tok), s AS (SELECT vec_id, sum(h * m) AS l, sum(m) AS n FROM h GROUP BY 1) SELECT round(sum(l) / sum(n), 5) AS token_mean, round(avg(l) FILTER (n > 0), 5) AS seq_mean_token_sum, round(avg(l / (n + 1e-8)) FILTER (n > 0), 5) AS seq_mean_token_mean FROM s",
    "l36_combined_loss": f"{_TOK}, {_PAR}, k AS (SELECT *, least(greatest(ref - new, -20), 20) AS x FROM clip), g AS (SELECT sum(CASE WHEN adv < 0 THEN least(three, greatest(one, two)) ELSE greatest(one, two) END * m) / sum(m) AS pg, sum(abs(e) * m) / sum(m) AS ent, sum(least(greatest(exp(x) - x - 1, -10), 10) * m) / sum(m) AS kl FROM k) SELECT round(pg, 5) AS pg_loss, round(ent, 5) AS entropy, round(kl, 5) AS kl_loss, round(pg - 0.01 * ent + 0.2 * kl, 5) AS loss FROM g",
    "l42_response_logprobs": f"{_TOK} SELECT vec_id, pos, round(CASE WHEN e > 0.2 THEN e WHEN e < -0.2 THEN -e ELSE 0.5 END - ln(exp(e) + exp(-e) + exp(0.5::DOUBLE)), 5) AS logprob FROM tok",
    "l44_kept_logits": f"{_TOK}, k AS (SELECT vec_id, e / 0.25 AS z, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC) AS r FROM tok), p AS (SELECT vec_id, z, r, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM k WHERE r <= 10), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, CAST(count(*) FILTER (before <= 0.7) AS INT) AS kept, round(sum(z) FILTER (before <= 0.7), 5) AS total FROM c GROUP BY 1",
    "l17_kl_controllers": "WITH e AS (SELECT event_id // 200 AS step, avg(value) AS kl, count(*) AS n FROM events GROUP BY 1) SELECT step, round(0.2 * exp(sum(ln(1 + least(greatest(kl / 50 - 1, -0.2), 0.2) * n / 1000)) OVER (ORDER BY step)), 8) AS coef, 0.3::DOUBLE AS fixed FROM e",
    "a04_mean_max_min_std": f"{_TOK} SELECT round(avg(adv), 5) AS mean, round(max(adv), 5) AS max, round(min(adv), 5) AS min, round(stddev_samp(adv), 5) AS std FROM tok",
    "w01_gae": f"{_TOK}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pos DESC) AS j, lead(val) OVER (PARTITION BY vec_id ORDER BY pos) AS nv FROM tok WHERE m = 1), d AS (SELECT vec_id, pos, adv + 0.9 * coalesce(nv, 0) - val AS d, j FROM k), a AS (SELECT x.vec_id, x.pos, sum(y.d * 0.72 ^ (x.j - y.j)) AS a FROM d x JOIN d y ON x.vec_id = y.vec_id AND y.pos >= x.pos GROUP BY 1, 2) SELECT t.vec_id, t.pos, round(coalesce((SELECT a FROM a WHERE a.vec_id = t.vec_id AND a.pos = (SELECT min(pos) FROM a b WHERE b.vec_id = t.vec_id AND b.pos >= t.pos)), 0), 5) AS advantage FROM tok t",
    "w09_discounted_returns": f"{_TOK}, g AS (SELECT *, coalesce(sum(1 - m) OVER (PARTITION BY vec_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM tok) SELECT x.vec_id, x.pos, round(sum(y.adv * 0.9 ^ (y.pos - x.pos)), 5) AS ret FROM g x JOIN g y ON x.vec_id = y.vec_id AND x.g = y.g AND y.pos >= x.pos GROUP BY 1, 2",
    "w10_reverse_cumsum": f"{_TOK} SELECT vec_id, pos, round(sum(adv * m) OVER (PARTITION BY vec_id ORDER BY pos DESC), 5) AS ret FROM tok",
    "w18_position_ids": f"{_TOK}, c AS (SELECT vec_id, pos, greatest(sum(m) OVER (PARTITION BY vec_id ORDER BY pos) - 1, 0) AS p FROM tok) SELECT vec_id, string_agg(CAST(p AS INT), ',' ORDER BY pos) AS positions FROM c GROUP BY 1",
    "r11_eos_mask": f"{_TOK} SELECT vec_id, coalesce(min(pos) FILTER (floor(abs(e) * 20) IN (1, 3)) + 1, 64) AS n FROM tok GROUP BY 1",
    "x08_overlong_penalty": "SELECT doc_id, round(least(-(n_chars - 3000) / 1000.0, 0), 6)::DOUBLE AS penalty FROM documents",
    "l29_dpo": f"{_TOK}, x AS (SELECT vec_id, max(old) FILTER (pos = 0) - max(old) FILTER (pos = 1) - max(ref) FILTER (pos = 0) + max(ref) FILTER (pos = 1) AS x FROM tok GROUP BY 1) SELECT vec_id, round(0.9 * ln(1 + exp(-0.5 * x)) + 0.1 * ln(1 + exp(0.5 * x)), 6) AS sigmoid, round((x - 1) ^ 2, 6) AS ipo FROM x",
    "l34_bce": f"{_TOK}, x AS (SELECT vec_id, 0.05 * sum(adv * m) AS z, any_value(label) % 2 AS y FROM tok GROUP BY 1) SELECT vec_id, round(greatest(z, 0) - z * y + ln(1 + exp(-abs(z))), 6) AS loss FROM x",
}

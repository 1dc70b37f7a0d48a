"""Token-level analytics over array columns: masked aggregates, divergences, importance weights and losses.

One row holds one sequence, and its token columns are arrays of one length.  Whatever a loss needs of a row is summed in
one fold over the zipped base columns, so no token is shuffled or exploded; what crosses the network is a handful of sums a
task.  Arrays that enter a lambda are plain columns, never expressions, which would be evaluated anew for every token.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
#: Log-ratios are held within this bound before they are exponentiated.
SAFETY = 20.0
OLD, NEW, ADV, MASK, REF, VALUES, RETURNS, VPRED = "old_log_prob", "log_prob", "advantages", "response_mask", "ref_log_prob", "values", "returns", "vpreds"

Token = Callable[[Column], Column]


def clamp(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    if lo is not None:
        x = F.greatest(x, lo if isinstance(lo, Column) else F.lit(float(lo)))
    return x if hi is None else F.least(x, hi if isinstance(hi, Column) else F.lit(float(hi)))


def live(t: Column, mask: str = MASK) -> Column:
    return t[mask] != 0


def sums(columns: Sequence[str], mask: str | None = MASK, **exprs: Token) -> Column:
    """A struct of sums over the tokens under the mask, and ``n``, their number, in one fold.  NaN outside counts nothing."""
    names = [*exprs, "n"]
    cols = [*dict.fromkeys([*columns, *([mask] if mask else [])])]

    def merge(acc: Column, t: Column) -> Column:
        on = live(t, mask) if mask else F.lit(True)
        return F.struct(*[(acc[k] + F.when(on, f(t).cast("double")).otherwise(0.0)).alias(k) for k, f in exprs.items()], (acc["n"] + F.when(on, 1.0).otherwise(0.0)).alias("n"))

    return F.aggregate(F.arrays_zip(*cols), F.struct(*[F.lit(0.0).alias(k) for k in names]), merge)


def each(columns: Sequence[str], f: Token) -> Column:
    """A new token column."""
    return F.transform(F.arrays_zip(*columns), f)


def masked_sum(values: str, mask: str = MASK) -> Column:
    return sums([values], mask, v=lambda t: t[values])["v"]


def masked_mean(values: str, mask: str = MASK) -> Column:
    """Row-wise masked sum / (mask + 1e-8)."""
    s = sums([values], mask, v=lambda t: t[values])
    return s["v"] / (s["n"] + EPS)


def total_mean(s: str, k: str) -> Column:
    """Masked mean over all rows, from a struct of row sums."""
    return F.sum(f"{s}.{k}") / (F.sum(f"{s}.n") + EPS)


def masked_stats(df: DataFrame, values: str, mask: str = MASK) -> DataFrame:
    """One row: n, mean (with epsilon) and the variance with Bessel's correction; n of 0 or 1 raises.

    One pass: a row gives its number, sum and sum of squares about its own mean, which add up without cancelling.
    """
    first = df.select(values, mask, sums([values], mask, v=lambda t: t[values]).alias("_s"))
    own = first.withColumn("_mu", F.array_repeat(F.coalesce(F.try_divide("_s.v", "_s.n"), F.lit(0.0)), F.size(values)))
    rows = own.select("_s.n", "_s.v", sums([values, "_mu"], mask, q=lambda t: (t[values] - t["_mu"]) * (t[values] - t["_mu"]))["q"].alias("q"), F.coalesce(F.try_divide(F.col("_s.v") * F.col("_s.v"), F.col("_s.n")), F.lit(0.0)).alias("m"))
    total = rows.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("q").alias("q"), F.sum("m").alias("m"))
    mean = F.col("v") / (F.col("n") + EPS)
    about = F.col("q") + F.greatest(F.col("m") - F.col("v") * F.col("v") / F.col("n"), F.lit(0.0)) + F.col("n") * F.pow(F.col("v") / F.col("n") - mean, 2)
    bad = F.raise_error(F.lit("masked_var: the mask has fewer than two elements")).cast("double")
    return total.select("n", mean.alias("mean"), F.when(F.coalesce(F.col("n"), F.lit(0)) <= 1, bad).otherwise(about / (F.col("n") + EPS) * F.col("n") / (F.col("n") - 1)).alias("var"))


def masked_whiten(df: DataFrame, values: str, out: str, mask: str = MASK, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with the statistics of all masked tokens; the one-row table is broadcast."""
    stats = F.broadcast(masked_stats(df, values, mask).select(F.col("mean").alias("_mu"), F.col("var").alias("_var")))
    white = F.transform(values, lambda x: (x - F.col("_mu")) / F.sqrt(F.col("_var") + EPS) + (F.lit(0.0) if shift_mean else F.col("_mu")))
    return df.crossJoin(stats).withColumn(out, white).drop("_mu", "_var")


def aggregate_loss(s: str, k: str, mode: str = "token-mean", width: float | None = None) -> Column:
    """The four ways to reduce row sums: over tokens, or over rows that have tokens."""
    row, n = F.col(f"{s}.{k}"), F.col(f"{s}.n")
    if mode == "token-mean":
        return F.sum(row) / F.sum(n)
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(n > 0, row)) / F.sum((n > 0).cast("double"))
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(n > 0, row / (n + EPS))) / F.sum((n > 0).cast("double"))
    if mode == "seq-mean-token-sum-norm":
        if not width:
            raise ValueError("seq-mean-token-sum-norm needs the padded width")
        return F.sum(row) / width
    raise ValueError(f"no such mode: {mode}")


# --- divergences ---
def kl(log_prob: Column, ref: Column, kind: str = "kl") -> Column:
    """Per-token divergence: kl/k1, abs, mse/k2, low_var_kl/k3; a "+" changes gradients only, so not the value."""
    kind, d = kind.rstrip("+"), log_prob - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = clamp(-d, -SAFETY, SAFETY)
        return clamp(F.exp(x) - x - 1, -10, 10)
    raise NotImplementedError(kind)


def penalized_rewards(scores: str, log_prob: str = OLD, ref: str = REF, beta: float = 0.1, kind: str = "kl", mask: str = MASK) -> Column:
    return each([scores, log_prob, ref, mask], lambda t: t[scores] - beta * kl(t[log_prob], t[ref], kind) * t[mask])


def batch_kl(df: DataFrame, log_prob: str = OLD, ref: str = REF, kind: str = "kl", mask: str = MASK) -> DataFrame:
    """Mean over rows of their masked mean divergence, and the number of rows."""
    s = df.select(sums([log_prob, ref], mask, k=lambda t: kl(t[log_prob], t[ref], kind)).alias("_s"))
    return s.agg(F.avg(F.col("_s.k") / (F.col("_s.n") + EPS)).alias("kl"), F.count("*").alias("rows"))


class AdaptiveKL:
    """Coefficient that follows a target: each batch multiplies it by 1 + clip(kl / target - 1, +-0.2) * n / horizon."""

    def __init__(self, value: float, target: float, horizon: float):
        if horizon <= 0:
            raise ValueError("the horizon must be positive")
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, current: float, n: int) -> float:
        self.value *= 1 + min(max(current / self.target - 1, -0.2), 0.2) * n / self.horizon
        return self.value


class FixedKL:
    def __init__(self, value: float):
        self.value = value

    def update(self, current: float, n: int) -> float:
        return self.value


def kl_controller(kind: str, value: float, target: float = 0.1, horizon: float = 10_000) -> AdaptiveKL | FixedKL:
    if kind == "adaptive":
        return AdaptiveKL(value, target, horizon)
    if kind == "fixed":
        return FixedKL(value)
    raise NotImplementedError(kind)


# --- policy losses: name -> function(df, mode, width, **options) giving one row ---
POLICY_LOSSES: dict[str, Callable[..., DataFrame]] = {}


def policy_loss(name: str):
    def add(f):
        POLICY_LOSSES[name] = f
        return f

    return add


def get_policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no policy loss {name!r}; there are {sorted(POLICY_LOSSES)}")
    return POLICY_LOSSES[name]


def _weight(t: Column, weights: str | None) -> Column:
    return t[weights] if weights else F.lit(1.0)


@policy_loss("vanilla")
def ppo_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, low: float = 0.2, high: float = 0.2, bound: float = 3.0, weights: str | None = None) -> DataFrame:
    """Dual-clip objective: log-ratio within +-20, ratio clipped, and for negative advantages no loss above bound * |A|."""
    if bound <= 1.0:
        raise ValueError("the lower bound must exceed 1")

    def parts(t):
        d = clamp(t[NEW] - t[OLD], -SAFETY, SAFETY)
        one = -t[ADV] * F.exp(d)
        two = -t[ADV] * clamp(F.exp(d), 1 - low, 1 + high)
        return d, one, two, F.greatest(one, two), -t[ADV] * bound

    def loss(t):
        _, _, _, clipped, three = parts(t)
        return F.when(t[ADV] < 0, F.least(three, clipped)).otherwise(clipped) * _weight(t, weights)

    s = sums([OLD, NEW, ADV, *([weights] if weights else [])], loss=loss, clip=lambda t: (parts(t)[2] > parts(t)[1]).cast("double"), kl=lambda t: -parts(t)[0], lower=lambda t: ((parts(t)[3] > parts(t)[4]) & (t[ADV] < 0)).cast("double"))
    return df.select(s.alias("s")).agg(aggregate_loss("s", "loss", mode, width).alias("pg_loss"), total_mean("s", "clip").alias("pg_clipfrac"), total_mean("s", "kl").alias("ppo_kl"), total_mean("s", "lower").alias("pg_clipfrac_lower"))


@policy_loss("gspo")
def gspo_loss(df: DataFrame, mode: str = "seq-mean-token-mean", width: float | None = None, *, low: float = 0.2, high: float = 0.2, weights: str | None = None) -> DataFrame:
    """Sequence-level ratio exp(mean log-ratio), at most e^10; always reduced as seq-mean-token-mean."""
    seq = sums([OLD, NEW], d=lambda t: t[NEW] - t[OLD])
    rows = df.withColumn("_q", seq).withColumn("_ratio", F.array_repeat(F.exp(clamp(F.col("_q.d") / F.greatest(F.col("_q.n"), F.lit(1.0)), hi=10.0)), F.size(OLD)))

    def one(t):
        return -t[ADV] * t["_ratio"]

    def two(t):
        return -t[ADV] * clamp(t["_ratio"], 1 - low, 1 + high)

    s = sums([OLD, NEW, ADV, "_ratio", *([weights] if weights else [])], loss=lambda t: F.greatest(one(t), two(t)) * _weight(t, weights), clip=lambda t: (two(t) > one(t)).cast("double"), kl=lambda t: t[OLD] - t[NEW])
    return rows.select(s.alias("s")).agg(aggregate_loss("s", "loss", "seq-mean-token-mean").alias("pg_loss"), total_mean("s", "clip").alias("pg_clipfrac"), total_mean("s", "kl").alias("ppo_kl"), F.lit(0.0).alias("pg_clipfrac_lower"))


@policy_loss("gpg")
def gpg_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, weights: str | None = None) -> DataFrame:
    s = sums([NEW, ADV, *([weights] if weights else [])], loss=lambda t: -t[NEW] * t[ADV] * _weight(t, weights))
    return df.select(s.alias("s")).agg(aggregate_loss("s", "loss", mode, width).alias("pg_loss"))


@policy_loss("geo_mean")
def geo_mean_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, low: float = 0.2, high: float = 0.2, weights: str | None = None) -> DataFrame:
    """Log-ratios clipped on the side of the advantage's sign, geometric-mean ratio a row, plain mean over rows."""

    def clipped(t):
        return clamp(t[NEW] - t[OLD], -low, high)

    def kept(t):
        sign = F.signum(t[ADV])
        return sign * F.least(sign * (t[NEW] - t[OLD]), sign * clipped(t))

    cut = lambda t: clipped(t) != t[NEW] - t[OLD]
    s = sums([OLD, NEW, ADV, *([weights] if weights else [])], d=kept, a=lambda t: t[ADV], w=lambda t: F.log(_weight(t, weights) + 1e-10), hi=lambda t: (cut(t) & (t[ADV] > 0)).cast("double"), lo=lambda t: (cut(t) & (t[ADV] < 0)).cast("double"), kl=lambda t: t[OLD] - t[NEW])
    n = F.col("s.n") + EPS
    row = -(F.col("s.a") / n) * F.exp(F.col("s.d") / n)
    return df.select(s.alias("s")).agg(F.avg(row * F.exp(F.col("s.w") / n) if weights else row).alias("pg_loss"), total_mean("s", "hi").alias("pg_clipfrac"), total_mean("s", "kl").alias("ppo_kl"), total_mean("s", "lo").alias("pg_clipfrac_lower"))


#: Bins of one round of the search for a cut.
BINS = 4096


def smallest(tokens: DataFrame, key: str, k: int) -> tuple[float, int, int]:
    """The ``k``-th token by (key, row_id, pos) of a table of tokens: at or below it are exactly k (1 <= k <= their number).

    Each round counts the tokens by bin of the range that is left, so only BINS counts leave it; ties of the key are
    settled in the same way by row and then by position.
    """
    rest, cut = tokens, []
    for name, kind in ((key, "double"), ("row_id", "long"), ("pos", "long")):
        x = F.col(name)
        lo, hi = rest.agg(F.min(x), F.max(x)).first()
        while lo < hi:
            width = (hi - lo) / BINS if kind == "double" else -(-(hi - lo + 1) // BINS)
            if lo + width <= lo:  # the last two numbers of the range are neighbours
                width = hi - lo
            at = F.least(F.floor((x - lo) / width) if kind == "double" else F.expr(f"({name} - {lo}) div {width}"), F.lit(BINS - 1)).cast("int")
            counts = sorted(rest.filter(x.between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect())
            for r in counts:
                if k <= r["n"]:
                    break
                k -= r["n"]
            lo, hi = r["lo"], r["hi"]
        cut.append(lo)
        rest = rest.filter(x == F.lit(lo))
    return tuple(cut)


def _upto(row: Column, pos: Column, key: Column, cut: tuple[float, int, int]) -> Column:
    c, r, p = (F.lit(x) for x in cut)
    return (key < c) | ((key == c) & ((row < r) | ((row == r) & (pos <= p))))


def _positioned(df: DataFrame) -> DataFrame:
    """The rows with the masked means of advantages and log-probabilities, and each token's row and position as arrays."""
    mean = df.select(sums([NEW, ADV], a=lambda t: t[ADV], l=lambda t: t[NEW], k=lambda t: F.lit(1.0)).alias("s")).agg(total_mean("s", "a").alias("_a"), total_mean("s", "l").alias("_l"))
    rows = df.crossJoin(F.broadcast(mean))
    fill = lambda x: F.array_repeat(x, F.size(MASK))
    return rows.withColumns({"_pos": F.transform(MASK, lambda x, i: i.cast("long")), "_row": fill(F.col("row_id").cast("long")), "_ma": fill(F.col("_a")), "_ml": fill(F.col("_l"))})


def _covariance(t: Column) -> Column:
    return (t[ADV] - t["_ma"]) * (t[NEW] - t["_ml"])


_AT = ("_row", "_pos", "_ma", "_ml")


def _tokens(rows: DataFrame, columns: Sequence[str], key: Token, keep: Token) -> DataFrame:
    """row_id, pos and key of the masked tokens that ``keep`` keeps; they are never exchanged."""
    each_one = rows.select(F.explode(F.arrays_zip(*dict.fromkeys([*columns, MASK, *_AT]))).alias("t"))
    t = F.col("t")
    return each_one.filter(live(t) & keep(t)).select(F.col("t._row").alias("row_id"), F.col("t._pos").alias("pos"), key(t).alias("_key"))


@policy_loss("kl_cov")
def kl_cov_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, ratio: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """The max(1, int(n * ratio)) tokens of largest covariance bear coef * |log-ratio| on top (ties by row and position).

    Needs ``row_id``.  The cut is found by counts; the loss is then one fold a row.
    """
    rows = _positioned(df)
    n = df.select(sums([MASK], n1=lambda t: F.lit(1.0)).alias("s")).agg(F.sum("s.n")).first()[0]
    cut = smallest(_tokens(rows, [NEW, ADV], lambda t: -_covariance(t), lambda t: F.lit(True)), "_key", max(1, int(n * ratio)))
    d = lambda t: t[NEW] - t[OLD]
    more = lambda t: F.when(_upto(t["_row"], t["_pos"], -_covariance(t), cut), coef * F.abs(d(t))).otherwise(0.0)
    s = sums([OLD, NEW, ADV, *_AT], loss=lambda t: -t[ADV] * F.exp(d(t)) + more(t))
    return rows.select(s.alias("s")).agg(aggregate_loss("s", "loss", mode, width).alias("pg_loss"))


def token_draw(row: Column, pos: Column, seed: int) -> Column:
    """A number below 2^31 that shuffles tokens; plain integer arithmetic, so that any engine gives the same."""
    x = F.pmod(row * 48271 + pos * 69621 + F.lit(seed * 16807 + 12345), F.lit(2147483647))
    return F.pmod(x * 48271, F.lit(2147483647)).cast("double")


@policy_loss("clip_cov")
def clip_cov_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, low: float = 0.2, high: float = 0.2, ratio: float = 0.0002, lb: float = 1.0, ub: float = 5.0, seed: int = 0) -> DataFrame:
    """A seeded choice of max(1, int(n * ratio)) unclipped tokens within the covariance band counts nothing.

    Needs ``row_id``.  The choice takes the tokens whose ``token_draw`` is smallest, and all if there are fewer.
    """
    rows = _positioned(df)
    one = lambda t: -t[ADV] * F.exp(t[NEW] - t[OLD])
    two = lambda t: -t[ADV] * clamp(F.exp(t[NEW] - t[OLD]), 1 - low, 1 + high)
    band = lambda t: (_covariance(t) > lb) & (_covariance(t) < ub) & ~(two(t) > one(t))
    draw = lambda t: token_draw(t["_row"], t["_pos"], seed)
    found = rows.select(sums([OLD, NEW, ADV, *_AT], band=lambda t: band(t).cast("double")).alias("s")).agg(F.sum("s.n").alias("n"), F.sum("s.band").alias("band")).first()
    k = int(min(found["band"] or 0, max(1, int(found["n"] * ratio))))
    cut = smallest(_tokens(rows, [OLD, NEW, ADV], draw, band), "_key", k) if k else None
    gone = (lambda t: band(t) & _upto(t["_row"], t["_pos"], draw(t), cut)) if k else lambda t: F.lit(False)
    s = sums([OLD, NEW, ADV, *_AT], loss=lambda t: F.when(gone(t), 0.0).otherwise(F.greatest(one(t), two(t))))
    return rows.select(s.alias("s")).agg(aggregate_loss("s", "loss", mode, width).alias("pg_loss"))


def value_loss(df: DataFrame, clip: float = 0.2, mode: str = "token-mean", width: float | None = None) -> DataFrame:
    def both(t):
        held = clamp(t[VPRED], t[VALUES] - clip, t[VALUES] + clip)
        return (t[VPRED] - t[RETURNS]) * (t[VPRED] - t[RETURNS]), (held - t[RETURNS]) * (held - t[RETURNS])

    s = sums([VPRED, VALUES, RETURNS], loss=lambda t: F.greatest(*both(t)), clip=lambda t: (both(t)[1] > both(t)[0]).cast("double"))
    return df.select(s.alias("s")).agg((0.5 * aggregate_loss("s", "loss", mode, width)).alias("vf_loss"), total_mean("s", "clip").alias("vf_clipfrac"))


# --- rollout correction ---
def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False, out: str = "rollout_is_weights", rollout: str = REF, train: str = OLD) -> DataFrame:
    """exp(log-ratio) a token, or of the whole sequence, within e^+-20, zero off the mask, truncated; then mean one if asked."""
    if level == "token":
        rows = df.withColumn(out, each([train, rollout, MASK], lambda t: clamp(F.exp(clamp(t[train] - t[rollout], -SAFETY, SAFETY)) * t[MASK], hi=threshold)))
    elif level == "sequence":
        total = sums([train, rollout], d=lambda t: t[train] - t[rollout])["d"]
        rows = df.withColumn("_w", F.array_repeat(F.exp(clamp(total, -SAFETY, SAFETY)), F.size(train))).withColumn(out, each(["_w", MASK], lambda t: clamp(t["_w"] * t[MASK], hi=threshold))).drop("_w")
    else:
        raise ValueError(f"no such level: {level}")
    if not normalize:
        return rows
    s = rows.select(sums([out], w=lambda t: t[out]).alias("s"))
    mean = total_mean("s", "w") if level == "token" else aggregate_loss("s", "w", "seq-mean-token-mean")
    return rows.crossJoin(F.broadcast(s.agg(mean.alias("_m")))).withColumn(out, F.when(F.col("_m") > EPS, F.transform(out, lambda x: x / F.col("_m"))).otherwise(F.col(out))).drop("_m")


def rejection_mask(df: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None, veto: float | None = None, rollout: str = REF, train: str = OLD) -> DataFrame:
    """The response mask where the ratio (of the token, the sequence, or its geometric mean) lies in [lower, upper].

    ``lower`` is 1 / upper by default.  With ``veto`` a row with any token ratio below it loses its whole mask.
    """
    lower = 1 / upper if lower is None else lower
    total = sums([train, rollout], d=lambda t: t[train] - t[rollout])
    rows = df.withColumn("_s", total)
    if level == "token":
        ok = each([train, rollout, MASK], lambda t: F.when(F.exp(clamp(t[train] - t[rollout], -SAFETY, SAFETY)).between(lower, upper), t[MASK]).otherwise(0).cast("int"))
    elif level in ("sequence", "geometric"):
        d = F.col("_s.d") if level == "sequence" else F.col("_s.d") / (F.col("_s.n") + EPS)
        ok = F.when(F.exp(clamp(d, -SAFETY, SAFETY)).between(lower, upper), F.col(MASK)).otherwise(F.transform(MASK, lambda x: F.lit(0).cast("int")))
    else:
        raise ValueError(f"no such level: {level}")
    if veto is not None:
        if veto <= 0:
            raise ValueError("the veto threshold must be positive")
        bad = F.exists(F.arrays_zip(train, rollout, MASK), lambda t: (F.exp(t[train] - t[rollout]) < veto) & live(t))
        ok = F.when(bad, F.transform(MASK, lambda x: F.lit(0).cast("int"))).otherwise(ok)
    return rows.withColumn(MASK, ok).drop("_s")


def off_policy_metrics(df: DataFrame, rollout: str = REF, train: str = OLD) -> DataFrame:
    """One row: perplexities, divergences and chi-squared of the training policy against the one that rolled out."""
    s = sums([train, rollout], a=lambda t: t[train], b=lambda t: t[rollout], k3=lambda t: F.exp(t[train] - t[rollout]) - (t[train] - t[rollout]) - 1, sq=lambda t: F.exp(2 * clamp(t[train] - t[rollout], -SAFETY, SAFETY)))
    rows = df.select(s.alias("s")).withColumns({"ma": F.col("s.a") / (F.col("s.n") + EPS), "mb": F.col("s.b") / (F.col("s.n") + EPS)})
    diff = F.col("mb") - F.col("ma")
    return rows.agg(
        F.avg(F.exp(-F.col("ma"))).alias("training_ppl"), F.avg(-F.col("ma")).alias("training_log_ppl"), ((F.sum("s.b") - F.sum("s.a")) / (F.sum("s.n") + EPS)).alias("kl"), total_mean("s", "k3").alias("k3_kl"),
        F.avg(F.exp(-F.col("mb"))).alias("rollout_ppl"), F.avg(-F.col("mb")).alias("rollout_log_ppl"), F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"), F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"), (total_mean("s", "sq") - 1).alias("chi2_token"), (F.avg(F.exp(2 * clamp(F.col("s.a") - F.col("s.b"), -SAFETY, SAFETY))) - 1).alias("chi2_seq"),
    )


def weight_metrics(df: DataFrame, upper: float, lower: float, rollout: str = REF, train: str = OLD) -> DataFrame:
    """One row on token-level weights: mean, extremes, share above and below, deviation, effective sample size, row means."""
    w = lambda t: F.exp(clamp(t[train] - t[rollout], -SAFETY, SAFETY))
    held = lambda t: clamp(w(t), lower, upper)
    zipped = F.filter(F.arrays_zip(train, rollout, MASK), lambda t: live(t))
    rows = df.select(sums([train, rollout], w=w, c=held, c2=lambda t: held(t) * held(t), hi=lambda t: (w(t) > upper).cast("double"), lo=lambda t: (w(t) < lower).cast("double")).alias("s"), F.array_max(F.transform(zipped, w)).alias("top"), F.array_min(F.transform(zipped, w)).alias("low"))
    rows = rows.withColumn("m", F.col("s.w") / (F.col("s.n") + EPS))
    mean, square = total_mean("s", "c"), total_mean("s", "c2")
    return rows.agg(
        total_mean("s", "w").alias("mean"), F.max("top").alias("max"), F.min("low").alias("min"), total_mean("s", "hi").alias("fraction_high"), total_mean("s", "lo").alias("fraction_low"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        ((mean + EPS) * (mean + EPS) / square).alias("eff_sample_size"), F.avg("m").alias("seq_mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("seq_std"), F.max("m").alias("seq_max"), F.min("m").alias("seq_min"),
        F.max(F.abs(F.col("m") - 1)).alias("seq_max_deviation"), F.avg((F.col("m") > upper).cast("double")).alias("seq_fraction_high"), F.avg((F.col("m") < lower).cast("double")).alias("seq_fraction_low"),
    )


def _row_statistics(rollout: str, train: str, bounds: dict[str, tuple[float, float]], veto: float | None) -> Column:
    """All sums over a row's tokens that the metrics of a correction need; ``bounds``: name -> (upper, lower)."""
    r = lambda t: t[train] - t[rollout]
    w = lambda t: F.exp(clamp(r(t), -SAFETY, SAFETY))
    parts: dict[str, Token] = {"d": r, "w": w}
    for name, (upper, lower) in bounds.items():
        parts |= {
            f"{name}_c": lambda t, u=upper, l=lower: clamp(w(t), l, u), f"{name}_q": lambda t, u=upper, l=lower: clamp(w(t), l, u) * clamp(w(t), l, u),
            f"{name}_hi": lambda t, u=upper: (w(t) > u).cast("double"), f"{name}_lo": lambda t, l=lower: (w(t) < l).cast("double"),
        }
    if veto is not None:
        parts["bad"] = lambda t: (r(t) < F.log(F.lit(float(veto)))).cast("double")
    return sums([train, rollout], **parts)


def _level_metrics(level: str, name: str, prefix: str, upper: float, lower: float) -> dict[str, Column]:
    """Statistics of weights at a level, as aggregates over rows with s (``_row_statistics``), top and low."""
    n, total = F.col("s.n"), F.sum("s.n") + EPS
    if level == "token":
        mean, share, square = F.sum("s.w") / total, F.sum(f"s.{name}_c") / total, F.sum(f"s.{name}_q") / total
        seq = F.col("s.w") / (n + EPS)
        out = {"max": F.max("top"), "min": F.min("low"), "ratio_fraction_high": F.sum(f"s.{name}_hi") / total, "ratio_fraction_low": F.sum(f"s.{name}_lo") / total}
    else:
        x = F.col("s.d") if level == "sequence" else F.col("s.d") / (n + EPS)
        w = F.exp(clamp(x, -SAFETY, SAFETY))
        c = clamp(w, lower, upper)
        mean, share, square = F.sum(w * n) / total, F.sum(c * n) / total, F.sum(c * c * n) / total
        seq = w * n / (n + EPS)
        high, low = F.log(F.lit(float(upper))), F.log(F.lit(float(lower)))
        out = {"max": F.exp(F.least(F.max(x), F.lit(SAFETY))), "min": F.exp(F.min(x)), "ratio_fraction_high": F.avg((x > high).cast("double")), "ratio_fraction_low": F.avg((x < low).cast("double"))}
    out |= {
        "mean": mean, "std": F.when(F.sum("s.n") > 1, F.sqrt(F.greatest(square - share * share, F.lit(0.0)))).otherwise(0.0), "eff_sample_size": (share + EPS) * (share + EPS) / square,
        "seq_mean": F.avg(seq), "seq_std": F.coalesce(F.stddev_samp(seq), F.lit(0.0)), "seq_max": F.max(seq), "seq_min": F.min(seq), "seq_max_deviation": F.max(F.abs(seq - 1)),
        "seq_fraction_high": F.avg((seq > upper).cast("double")), "seq_fraction_low": F.avg((seq < lower).cast("double")),
    }
    return {f"{prefix}_{k}": v for k, v in out.items()}


def _accepted(level: str, upper: float, lower: float) -> tuple[Column, Column]:
    """Of a row (s): how many of its tokens are rejected, and whether any is."""
    n = F.col("s.n")
    if level == "token":
        out = F.col("s.rs_hi") + F.col("s.rs_lo")
        return out, out > 0
    w = F.exp(clamp(F.col("s.d") if level == "sequence" else F.col("s.d") / (n + EPS), -SAFETY, SAFETY))
    return F.when(w.between(lower, upper), 0.0).otherwise(n), ~w.between(lower, upper)


def correction_metrics(df: DataFrame, *, weights: str | None = None, threshold: float = 2.0, reject: str | None = None, upper: float | None = None, lower: float | None = None, veto: float | None = None, normalize: bool = False, rollout: str = REF, train: str = OLD) -> DataFrame:
    """One row: the statistics of weights, of the rejection and of the veto, and the off-policy metrics, of one pass."""
    upper, lower = upper if upper is not None else threshold, lower if lower is not None else 1 / (upper if upper is not None else threshold)
    bounds = ({"is": (threshold, 1 / threshold)} if weights else {}) | ({"rs": (upper, lower)} if reject else {})
    pairs = F.filter(F.arrays_zip(train, rollout, MASK), lambda t: live(t))
    ratio = F.transform(pairs, lambda t: F.exp(clamp(t[train] - t[rollout], -SAFETY, SAFETY)))
    held = F.aggregate(ratio, F.lit(0.0), lambda a, x: a + F.least(x, F.lit(float(threshold))))
    rows = df.select(_row_statistics(rollout, train, bounds, veto).alias("s"), F.array_max(ratio).alias("top"), F.array_min(ratio).alias("low"), held.alias("held"))
    out: dict[str, Column] = {}
    if weights:
        out |= _level_metrics(weights, "is", "rollout_is", threshold, 1 / threshold)
        if normalize:
            if weights == "sequence":  # a sequence's weight is the same for all its tokens
                w = F.least(F.exp(clamp(F.col("s.d"), -SAFETY, SAFETY)), F.lit(float(threshold))) * F.col("s.n") / (F.col("s.n") + EPS)
                held = F.sum(F.when(F.col("s.n") > 0, w)) / F.greatest(F.sum((F.col("s.n") > 0).cast("double")), F.lit(EPS))
            else:
                held = F.sum("held") / (F.sum("s.n") + EPS)
            out["rollout_is_batch_norm_factor"] = F.when(held > EPS, held).otherwise(1.0)
    if reject:
        out |= _level_metrics(reject, "rs", "rollout_rs", upper, lower)
        gone, any_gone = _accepted(reject, upper, lower)
        out |= {"rollout_rs_masked_fraction": F.sum(gone) / (F.sum("s.n") + EPS), "rollout_rs_seq_masked_fraction": F.avg(any_gone.cast("double"))}
    out |= {"rollout_is_veto_fraction": F.avg((F.col("s.bad") > 0).cast("double")) if veto is not None else F.lit(0.0), "rollout_is_catastrophic_token_fraction": F.sum("s.bad") / (F.sum("s.n") + EPS) if veto is not None else F.lit(0.0)}
    empty = F.raise_error(F.lit("the mask has no token")).cast("double")
    checked = rows.agg(F.when(F.coalesce(F.sum("s.n"), F.lit(0.0)) == 0, empty).otherwise(F.sum("s.n")).alias("n_tokens"), *[c.alias(k) for k, c in out.items()])
    return checked.crossJoin(off_policy_metrics(df, rollout, train))


def corrected(df: DataFrame, *, weights: str | None = None, threshold: float = 2.0, reject: str | None = None, upper: float | None = None, lower: float | None = None, veto: float | None = None, normalize: bool = False, rollout: str = REF, train: str = OLD) -> DataFrame:
    """The batch with its response mask after rejection and veto, and rollout_is_weights if ``weights`` names a level.

    Weights and ratios are taken under the mask as it was.
    """
    if weights not in (None, "token", "sequence") or reject not in (None, "token", "sequence", "geometric"):
        raise ValueError(f"no such levels: {weights}, {reject}")
    if reject and upper is None:
        raise ValueError("a rejection needs its upper threshold")
    rows = importance_weights(df, weights, threshold, normalize, rollout=rollout, train=train) if weights else df
    if reject:
        return rejection_mask(rows, reject, upper, lower, veto, rollout, train)
    return vetoed(rows, veto, rollout, train) if veto is not None else rows


def vetoed(df: DataFrame, veto: float, rollout: str = REF, train: str = OLD) -> DataFrame:
    """Rows with any token ratio below ``veto`` lose their whole mask."""
    if veto <= 0:
        raise ValueError("the veto threshold must be positive")
    bad = F.exists(F.arrays_zip(train, rollout, MASK), lambda t: (F.exp(t[train] - t[rollout]) < veto) & live(t))
    return df.withColumn(MASK, F.when(bad, F.transform(MASK, lambda x: F.lit(0).cast("int"))).otherwise(F.col(MASK)))


def bypassed(df: DataFrame, *, rollout: str = REF, train: str = OLD, policy_gradient: bool = False) -> tuple[DataFrame, str]:
    """The batch with the rollout's log-probabilities as the old ones, and the loss that goes with it."""
    if rollout not in df.columns:
        raise ValueError(f"the batch has no {rollout}")
    return df.withColumn(train, F.col(rollout)), "rollout_correction" if policy_gradient else "vanilla"


@policy_loss("rollout_correction")
def rollout_corrected_loss(df: DataFrame, mode: str = "token-mean", width: float | None = None, *, scale: float = 1.0, **correction) -> DataFrame:
    """Policy gradient without clipping: -A * log-prob, by the weights of the current policy against the rollout (which is
    the old one here), under the mask that a rejection leaves.  ``correction``: see ``corrected``."""
    rows = corrected(df, rollout=OLD, train=NEW, **correction)
    if not correction.get("reject"):  # a veto alone doesn't change the loss's mask
        rows = corrected(df, rollout=OLD, train=NEW, **{k: v for k, v in correction.items() if k != "veto"})
    by = "rollout_is_weights" if correction.get("weights") else None
    s = sums([OLD, NEW, ADV, *([by] if by else [])], loss=lambda t: -t[ADV] * t[NEW] * _weight(t, by), kl=lambda t: t[OLD] - t[NEW])
    return rows.select(s.alias("s")).agg((aggregate_loss("s", "loss", mode, width) * scale).alias("pg_loss"), total_mean("s", "kl").alias("ppo_kl"))


# --- logits, pairs, sequences ---
def log_softmax_at(logits: str, label: Column) -> Column:
    """Log-softmax of an array of logits at a 0-based label."""
    top = F.array_max(logits)
    total = F.aggregate(F.col(logits), F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.get(F.col(logits), label) - top - F.log(total)


def entropy(logits: str | Column) -> Column:
    logits = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(logits)
    s = F.aggregate(logits, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("x")), lambda a, x: F.struct((a["z"] + F.exp(x - top)).alias("z"), (a["x"] + F.exp(x - top) * x).alias("x")))
    return top + F.log(s["z"]) - s["x"] / s["z"]


def token_logprobs(logits: str, labels: str) -> Column:
    """Log-softmax of every position's logits (an array of arrays) at its 0-based label."""

    def one(t: Column) -> Column:
        top = F.array_max(t[logits])
        return F.get(t[logits], t[labels]) - top - F.log(F.aggregate(t[logits], F.lit(0.0), lambda a, x: a + F.exp(x - top)))

    return F.transform(F.arrays_zip(logits, labels), one)


def top_k_logits(logits: str, k: int) -> Column:
    """The logits that are no smaller than the ``k``-th largest; null elsewhere."""
    least = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x >= least, x))


def top_p_logits(logits: str, p: float) -> Column:
    """The largest logits until their probability exceeds ``p``, the one that passes it included; null elsewhere."""
    there = F.filter(logits, lambda x: x.isNotNull())
    top, ranked = F.array_max(there), F.sort_array(there, asc=False)
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    zero = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("double").alias("least"))
    walk = F.aggregate(ranked, zero, lambda a, x: F.struct((a["mass"] + F.exp(x - top) / total).alias("mass"), F.when(a["mass"] <= p, x.cast("double")).otherwise(a["least"]).alias("least")))
    return F.transform(logits, lambda x: F.when(x >= walk["least"], x))


def combined_loss(df: DataFrame, entropies: str, *, name: str = "vanilla", mode: str = "token-mean", width: float | None = None, entropy_coef: float = 0.0, kl_coef: float = 0.0, kind: str = "low_var_kl", **options) -> DataFrame:
    """A policy loss less the entropy and plus the divergence from the reference, each by its coefficient; one row."""
    s = sums([entropies, NEW, REF], h=lambda t: t[entropies], k=lambda t: kl(t[NEW], t[REF], kind))
    more = df.select(s.alias("s")).agg(aggregate_loss("s", "h", mode, width).alias("entropy"), aggregate_loss("s", "k", mode, width).alias("kl_loss"))
    both = get_policy_loss(name)(df, mode, width, **options).select("pg_loss").crossJoin(more)
    return both.withColumn("loss", F.col("pg_loss") - entropy_coef * F.col("entropy") + kl_coef * F.col("kl_loss"))


def controlled(steps: DataFrame, step: str, current: str, n: str, controller: AdaptiveKL | FixedKL) -> DataFrame:
    """step, coef: the coefficient after each step's batch, a row a step of a training run."""
    rows = [(r[step], float(controller.update(r[current], r[n]))) for r in steps.orderBy(step).collect()]
    return steps.sparkSession.createDataFrame(rows, "step long, coef double")


def scaled_logits(logits: str, temperature: float) -> Column:
    return F.transform(logits, lambda x: x / temperature)


def normalized_logps(logps: str) -> Column:
    """Renormalize top-k log-probabilities."""
    top = F.array_max(logps)
    total = top + F.log(F.aggregate(F.col(logps), F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(logps, lambda x: x - total)


def topk_kl(teacher: str, student: str) -> Column:
    """Sum over the teacher's top-k of p * (log p - log q)."""
    return F.aggregate(F.arrays_zip(teacher, student), F.lit(0.0), lambda a, t: a + F.exp(t[teacher]) * (t[teacher] - t[student]))


def batch_logps(logps: str, labels: str, average: bool = False) -> Column:
    """Sum (or mean) of log-probabilities whose label is not -100."""
    s = F.aggregate(F.arrays_zip(logps, labels), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, t: F.struct((a["s"] + F.when(t[labels] != -100, t[logps]).otherwise(0.0)).alias("s"), (a["n"] + F.when(t[labels] != -100, 1.0).otherwise(0.0)).alias("n")))
    return F.try_divide(s["s"], s["n"]) if average else s["s"]


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False) -> Column:
    x = chosen - rejected - (F.lit(0.0) if reference_free else ref_chosen - ref_rejected)
    soft = lambda z: F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # noqa: E731  -log sigmoid(z)
    if kind == "sigmoid":
        return soft(beta * x) * (1 - smoothing) + soft(-beta * x) * smoothing
    if kind == "ipo":
        return (x - 1 / (2 * beta)) * (x - 1 / (2 * beta))
    raise ValueError(f"no such loss: {kind}")


def sppo_loss(df: DataFrame, reward: str, eta: float = 1.0) -> DataFrame:
    """Mean over rows with tokens of (sum of log-ratios - eta * reward)^2."""
    s = df.select(sums([OLD, NEW], d=lambda t: t[NEW] - t[OLD]).alias("s"), F.col(reward).alias("r"))
    x = F.col("s.d") - eta * F.col("r")
    return s.filter("s.n > 0").agg(F.avg(x * x).alias("loss"))


def flow_loss(df: DataFrame, reward: str, log_z: str, beta: float = 15.0, top: float = 10.0) -> DataFrame:
    """Trajectory balance: weight * (log Z + mean log-prob - beta * reward - mean reference)^2, importance weight at most ``top``."""
    s = df.select(sums([OLD, NEW, REF], d=lambda t: t[NEW] - t[OLD], p=lambda t: t[NEW], q=lambda t: t[REF]).alias("s"), F.col(reward).alias("r"), F.col(log_z).alias("z"))
    n = F.col("s.n") + EPS
    x = F.col("z") + F.col("s.p") / n - beta * F.col("r") - F.col("s.q") / n
    return s.agg(F.avg(clamp(F.exp(F.col("s.d")), hi=top) * x * x).alias("loss"))


def bce_loss(score: Column, label: Column, beta: float) -> Column:
    """Binary cross-entropy of sigmoid(beta * score) against the label."""
    z = beta * score
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))


def sft_loss(df: DataFrame, log_prob: str = NEW, mask: str = MASK) -> DataFrame:
    s = df.select(sums([log_prob], mask, v=lambda t: t[log_prob]).alias("s"))
    return s.agg((-F.sum("s.v") / F.sum("s.n")).alias("loss"))


def eos_mask(ids: str, eos: Sequence[int]) -> Column:
    """1 up to and including the first end token, then 0."""
    first = F.array_min(F.transform(F.array(*[F.lit(e).cast("long") for e in eos]), lambda e: F.nullif(F.array_position(F.transform(ids, lambda x: x.cast("long")), e), F.lit(0).cast("long"))))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i < first), 1).otherwise(0))


def position_ids(mask: str) -> Column:
    """Running sum of the mask less one, at least zero."""
    fold = F.aggregate(F.col(mask), F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n")), lambda a, x: F.struct(F.array_append(a["out"], F.greatest(a["n"] + x.cast("int") - 1, F.lit(0))).alias("out"), (a["n"] + x.cast("int")).alias("n")))
    return fold["out"]


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    return F.least(-(length - (most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


# --- folds along a sequence, from its end ---
def gae(rewards: str, values: str, mask: str = MASK, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Advantages before whitening; masked positions carry the next value and the sum along (see ``gae_batch``)."""
    zipped = F.reverse(F.arrays_zip(rewards, values, mask))
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("next"), F.lit(0.0).alias("last"))

    def step(a, t):
        on = t[mask] != 0
        last = F.when(on, t[rewards] + gamma * a["next"] - t[values] + gamma * lam * a["last"]).otherwise(a["last"])
        return F.struct(F.array_append(a["out"], last).alias("out"), F.when(on, t[values].cast("double")).otherwise(a["next"]).alias("next"), last.alias("last"))

    return F.reverse(F.aggregate(zipped, zero, step)["out"])


def gae_batch(df: DataFrame, rewards: str, values: str, mask: str = MASK, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """The batch with returns (advantages before whitening plus values) and advantages, whitened over all masked tokens."""
    rows = df.withColumn("_gae", gae(rewards, values, mask, gamma, lam))
    rows = rows.withColumn(RETURNS, F.transform(F.arrays_zip("_gae", values), lambda t: t["_gae"] + t[values]))
    return masked_whiten(rows, "_gae", ADV, mask).drop("_gae")


def discounted_returns(rewards: str, mask: str = MASK, gamma: float = 1.0, reset: bool = True) -> Column:
    """Reward-to-go; with ``reset`` the running sum starts anew after a masked position."""
    zipped = F.reverse(F.arrays_zip(rewards, mask))
    zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run"))

    def step(a, t):
        run = t[rewards].cast("double") + gamma * a["run"]
        return F.struct(F.array_append(a["out"], run).alias("out"), (F.when(t[mask] != 0, run).otherwise(0.0) if reset else run).alias("run"))

    return F.reverse(F.aggregate(zipped, zero, step)["out"])

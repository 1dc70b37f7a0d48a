"""Rewards: scoring functions by data source, reward managers, and the registries that users extend."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tokens import overlong_penalty
from . import answers

#: (text, truth) -> score, by data source; unknown sources raise.
Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def scorer(*sources: str):
    def add(f: Scorer) -> Scorer:
        for s in sources:
            SCORERS[s] = f
        return f

    return add


# The names of the data sources.
scorer("openai/gsm8k")(lambda t, g: answers.number_score(t, g))
scorer("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")(answers.boxed_score)
scorer("math_dapo", "math", "math_dapo_reasoning", "aime2024", "aime2025")(lambda t, g: answers.answer_line_score(t, g)["score"])
scorer("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle")(lambda t, g: answers.qa_score(t, F.array(g)))
scorer("gpqa")(answers.choice_score)


def score_by_source(source: Column, text: Column, truth: Column, scorers: dict[str, Scorer] | None = None) -> Column:
    """One pass for mixed sources: each row is scored by its source's function, an unknown source raises."""
    out = None
    for f in dict.fromkeys((scorers or SCORERS).values()):
        names = [k for k, v in (scorers or SCORERS).items() if v is f]
        out = F.when(source.isin(names), f(text, truth)) if out is None else out.when(source.isin(names), f(text, truth))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))


# --- managers ---
MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def manager(name: str):
    def add(f):
        MANAGERS[name] = f
        return f

    return add


def get_manager(name: str) -> Callable[..., DataFrame]:
    if name not in MANAGERS:
        raise ValueError(f"no reward manager {name!r}; there are {sorted(MANAGERS)}")
    return MANAGERS[name]


def scattered(score: Column, length: Column, width: Column) -> Column:
    """A reward array with the score at the last valid position; a row without a response is all zero."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.when(i == length, score).otherwise(0.0))


@manager("naive")
def naive(df: DataFrame, score: Column, length: str, width: int, out: str = "token_level_scores") -> DataFrame:
    """Scores of rows at their last token; a score column that is there already is kept."""
    given = F.coalesce(F.col("rm_score"), score) if "rm_score" in df.columns else score
    return df.withColumn("score", given).withColumn(out, scattered(F.col("score"), F.col(length), F.lit(width)))


@manager("batch")
def batch(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], length: str, width: int, out: str = "token_level_scores") -> DataFrame:
    """A scoring function over whole batches of rows; also gives ``acc``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=score(f).astype(float))

    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = df.drop("score").mapInPandas(run, StructType([*df.drop("score").schema.fields, StructField("score", DoubleType())]))
    return rows.withColumn("acc", F.col("score")).withColumn(out, scattered(F.col("score"), F.col(length), F.lit(width)))


@manager("dapo")
def dapo(df: DataFrame, score: Column, length: str, width: int, *, most: int, buffer: int, factor: float = 1.0, out: str = "token_level_scores") -> DataFrame:
    """naive, with the penalty on overlong responses added."""
    return naive(df, score + overlong_penalty(F.col(length), most, buffer, factor), length, width, out)


#: Threads that score rows in a task; seconds after which a row that hardly computes is waited for aside, and how many of a
#: task's rows are at once.
THREADS, PATIENCE, WAITING = 4, 0.02, 64


class _Scoring(threading.Thread):
    """Scores rows of a frame one after another, until there are none or another thread has its place."""

    def __init__(self, score: Callable[[dict], float], rows: Iterator[tuple[int, dict]], values: list, timeout: float, changed: threading.Condition):
        super().__init__(daemon=True)  # a scorer that never returns does not hold the task
        self.score, self.rows, self.values, self.timeout, self.changed = score, rows, values, timeout, changed
        self.at, self.began, self.used, self.clock, self.replaced, self.ended = None, time.monotonic(), 0.0, None, False, False
        self.start()

    def run(self) -> None:
        self.clock = time.pthread_getcpuclockid(threading.get_ident())
        while True:
            with self.changed:
                at, row = (None, None) if self.replaced else next(self.rows, (None, None))
                if row is None:
                    self.ended = True
                    self.changed.notify()
                    return
                self.at, self.used, self.began = at, time.thread_time(), time.monotonic()
            try:
                value = float(self.score(row))
            except Exception:  # noqa: BLE001  a scorer's failure is a score of 0
                value = 0.0
            self.values[at] = 0.0 if self.late() else value

    def late(self) -> bool:
        return time.monotonic() - self.began > self.timeout

    def waits(self) -> bool:
        """Whether its row has taken a while and under a twentieth of it on the processor."""
        ran = time.monotonic() - self.began
        return self.at is not None and ran > PATIENCE and time.clock_gettime(self.clock) - self.used < ran / 20

    def value(self) -> float:
        return 0.0 if self.values[self.at] is None else self.values[self.at]


@manager("prime")
def prime(df: DataFrame, score: Callable[[dict], float], length: str, width: int, *, timeout: float = 300.0, waiting: int = WAITING, out: str = "token_level_scores") -> DataFrame:
    """Row by row, each with a time limit from its own start; a failure or a late result scores 0.

    A row whose scorer waits (for a service, say) is set aside and another thread goes on with the rest, so up to ``waiting``
    rows of a task wait at the same time and come behind the others of their batch.  A late scorer's thread is given up.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        changed, aside = threading.Condition(), []

        def settled() -> Iterator[pd.DataFrame]:
            over = [s.ended or s.late() for _, s in aside]
            done = [x for x, o in zip(aside, over, strict=True) if o]
            aside[:] = [x for x, o in zip(aside, over, strict=True) if not o]
            if done:
                yield pd.concat([f for f, _ in done]).assign(score=[s.value() for _, s in done])

        for f in frames:
            rows, values, later = iter(enumerate(f.to_dict("records"))), [None] * len(f), set()
            busy = [_Scoring(score, rows, values, timeout, changed) for _ in range(min(THREADS, len(f)))]
            while busy:
                with changed:
                    changed.wait_for(lambda busy=busy: all(s.ended for s in busy), PATIENCE)
                    busy = [s for s in busy if not s.ended]
                    free = waiting - sum(not s.ended and not s.late() for _, s in aside)
                    for i, s in enumerate(busy):
                        late = s.at is not None and s.late()
                        if late or (free > 0 and s.waits()):
                            s.replaced = True
                            if late:
                                values[s.at] = s.value()
                            else:
                                free -= 1
                                later.add(s.at)
                                aside.append((f.iloc[[s.at]], s))
                            busy[i] = _Scoring(score, rows, values, timeout, changed)
            now = [i for i in range(len(f)) if i not in later]
            if now:
                yield f.iloc[now].assign(score=[values[i] for i in now])
            yield from settled()
        while aside:
            with changed:
                changed.wait_for(lambda: any(s.ended or s.late() for _, s in aside), PATIENCE)
            yield from settled()

    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = df.drop("score").mapInPandas(run, StructType([*df.drop("score").schema.fields, StructField("score", DoubleType())]))
    return rows.withColumn(out, scattered(F.col("score"), F.col(length), F.lit(width)))


@manager("rate_limited")
def rate_limited(df: DataFrame, score: Callable[[dict], float], length: str, width: int, *, per_second: float, out: str = "token_level_scores") -> DataFrame:
    """prime, at no more than ``per_second`` calls in each task (a limit across executors needs a service)."""

    def slow(row: dict, state={"next": 0.0}) -> float:  # noqa: B006  one pace a worker
        wait = state["next"] - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        state["next"] = max(time.monotonic(), state["next"]) + 1 / per_second
        return score(row)

    return prime(df, slow, length, width, waiting=0, out=out)


def load_function(path: str, name: str, **bound) -> Callable:
    """A user's function from a file, with bound arguments.  Every path has a module of its own."""
    spec = importlib.util.spec_from_file_location(f"user_function_{abs(hash(path))}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    f = getattr(module, name)
    return (lambda *a, **k: f(*a, **bound, **k)) if bound else f


# --- queries ---
def f34_score_by_source(spark, sf_dir):
    s = answers._solutions(spark, sf_dir)
    source = F.element_at(F.array(F.lit("openai/gsm8k"), F.lit("math_dapo"), F.lit("searchR1_nq")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    truth = F.when(F.col("o_orderkey") % 3 == 2, F.col("o_orderpriority")).otherwise(F.col("truth"))
    return s.select("o_orderkey", score_by_source(source, F.col("text"), truth).alias("score"))


def x06_scattered(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    rows = naive(li, F.col("l_discount"), "l_linenumber", 8)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_position("token_level_scores", F.col("l_discount")).alias("place"), F.round(F.aggregate("token_level_scores", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _responses(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", (F.col("o_custkey") % 9).cast("int").alias("len"), F.round(F.col("o_totalprice") / 1000, 3).alias("price"))


def x07_batch_scores(spark, sf_dir):
    """A scoring function over batches of rows; the score stands at the last token, and nowhere without one."""
    rows = get_manager("batch")(_responses(spark, sf_dir), lambda f: f["price"] - f["len"], "len", 8)
    return rows.select("o_orderkey", F.round("score", 4).alias("score"), F.round("acc", 4).alias("acc"), F.round(F.aggregate("token_level_scores", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def x09_guarded_scores(spark, sf_dir):
    """Row by row: a scorer that fails, and one that is late, give 0."""

    def score(row: dict) -> float:
        if row["o_orderkey"] % 7 == 0:
            raise RuntimeError("no score")
        if row["o_orderkey"] % 5000 == 1:
            time.sleep(3.0)
        return row["len"] * 2.0

    rows = get_manager("prime")(_responses(spark, sf_dir), score, "len", 8, timeout=1.5)
    return rows.select("o_orderkey", "score")


def x11_overlong_scores(spark, sf_dir):
    rows = get_manager("dapo")(_responses(spark, sf_dir), F.col("price"), "len", 8, most=8, buffer=4, factor=0.5)
    return rows.select("o_orderkey", F.round("score", 5).alias("score"))


def x12_given_scores(spark, sf_dir):
    """Scores of a reward model that are there already are kept."""
    rows = _responses(spark, sf_dir).withColumn("rm_score", F.when(F.col("len") > 4, F.lit(9.5)))
    return get_manager("naive")(rows, F.col("price"), "len", 8).select("o_orderkey", "score")


def x05_registries(spark, sf_dir):
    """The same rows under each manager that takes a column of scores, found by its name."""
    rows, out = _responses(spark, sf_dir).withColumn("rm_score", F.lit(None).cast("double")), None
    for name, options in (("naive", {}), ("dapo", {"most": 8, "buffer": 4})):
        part = get_manager(name)(rows, F.col("price"), "len", 8, **options).select(F.lit(name).alias("manager"), "o_orderkey", F.round("score", 4).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def x14_loaded_function(spark, sf_dir):
    """A user's scoring function from a file, with a bound argument, over whole batches."""
    path = os.path.join(tempfile.mkdtemp(), "scorer.py")  # on the driver, where it is loaded
    with open(path, "w") as f:
        f.write("def score(frame, factor=1):\n    return frame['len'] * factor\n")
    f = load_function(path, "score", factor=3)
    return get_manager("batch")(_responses(spark, sf_dir), f, "len", 8).select("o_orderkey", "score")


QUERIES = {f.__name__: f for f in (f34_score_by_source, x06_scattered, x07_batch_scores, x09_guarded_scores, x11_overlong_scores, x12_given_scores, x05_registries, x14_loaded_function)}
_R = "(SELECT o_orderkey, (o_custkey % 9)::INT AS len, round(o_totalprice / 1000, 3) AS price FROM orders)"
ORACLES = {
    "f34_score_by_source": f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN (o_orderkey % 8 = 0)::INT WHEN 1 THEN CASE WHEN coalesce({answers._PRED}, '') = (o_orderkey % 10000)::VARCHAR THEN 1 ELSE -1 END ELSE coalesce(({answers._STRICT} = (o_orderkey % 10000)::VARCHAR)::INT, 0) END::DOUBLE AS score FROM orders",
    "x07_batch_scores": f"SELECT o_orderkey, round(price - len, 4) AS score, round(price - len, 4) AS acc, CASE WHEN len > 0 AND len <= 8 THEN round(price - len, 4) ELSE 0 END AS total FROM {_R}",
    "x09_guarded_scores": f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5000 = 1 THEN 0 ELSE len * 2 END::DOUBLE AS score FROM {_R}",
    "x11_overlong_scores": f"SELECT o_orderkey, round(price + least(-(len - 4) / 4.0 * 0.5, 0), 5) AS score FROM {_R}",
    "x12_given_scores": f"SELECT o_orderkey, CASE WHEN len > 4 THEN 9.5 ELSE price END::DOUBLE AS score FROM {_R}",
    "x14_loaded_function": f"SELECT o_orderkey, (len * 3)::DOUBLE AS score FROM {_R}",
    "x05_registries": f"SELECT m AS manager, o_orderkey, round(price + CASE WHEN m = 'dapo' THEN least(-(len - 4) / 4.0, 0) ELSE 0 END, 4) AS score FROM {_R}, (SELECT unnest(['naive', 'dapo']) AS m)",
    "x06_scattered": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount = 0 THEN 1 ELSE l_linenumber END::BIGINT AS place, round(l_discount, 4) AS total FROM lineitem",
}

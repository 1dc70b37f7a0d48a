"""Dispatch of a frame to ranks and back: modes by name, each how rows go out and how results come together.

A rank is a column, not a machine: rows of a rank lie together after one exchange by it, and work on them runs side by
side.  In a mesh several ranks share a data-parallel number; they get the same rows, and one of them answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frame import ROW, SampleFrame, with_row_id

RANK = "rank"


@dataclass(frozen=True)
class Mode:
    """out(frame, ranks, mesh) gives rows with a rank; back(results, mesh) gives rows with row ids again."""

    out: Callable[[SampleFrame, int, dict[int, int] | None], DataFrame]
    back: Callable[[DataFrame, dict[int, int] | None], DataFrame]


MODES: dict[str, Mode] = {}


def register_mode(name: str, mode: Mode) -> None:
    if name in MODES:
        raise ValueError(f"there is a mode {name!r} already")
    MODES[name] = mode


def get_mode(name: str) -> Mode:
    if name not in MODES:
        raise ValueError(f"no dispatch mode {name!r}; there are {sorted(MODES)}")
    return MODES[name]


def chunked(f: SampleFrame, ranks: int) -> DataFrame:
    """Each rank gets as many consecutive rows; a frame that doesn't divide is padded with its first rows."""
    padded, _ = f.pad_to_divisor(ranks)
    size = max(1, padded.count() // ranks)
    return padded.df.withColumn(RANK, F.expr(f"cast({ROW} div {size} as int)"))


def everywhere(f: SampleFrame, ranks: int) -> DataFrame:
    return f.df.withColumn(RANK, F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def over_mesh(f: SampleFrame, mesh: dict[int, int]) -> DataFrame:
    """Chunks by data-parallel number, for every rank that has it."""
    dealt = chunked(f, len(set(mesh.values()))).withColumnRenamed(RANK, "_dp")
    numbers = sorted(set(mesh.values()))
    ranks = F.create_map(*[x for dp in numbers for x in (F.lit(dp), F.array(*[F.lit(r) for r, d in sorted(mesh.items()) if d == dp]))])
    return dealt.withColumn(RANK, F.explode(F.try_element_at(ranks, F.col("_dp")))).drop("_dp")


def in_order(results: DataFrame) -> DataFrame:
    """Results of all ranks one after the other, numbered anew."""
    keyed = results.withColumnRenamed(ROW, "_old")
    return with_row_id(keyed, [RANK, "_old"], ROW).drop("_old", RANK)


def first_of_mesh(results: DataFrame, mesh: dict[int, int]) -> DataFrame:
    """One rank of each data-parallel number answers, the smallest."""
    answer = sorted({min(r for r, d in mesh.items() if d == dp) for dp in set(mesh.values())})
    return in_order(results.filter(F.col(RANK).isin(answer)))


def unpadded(results: DataFrame, n: int) -> DataFrame:
    """Without the rows that padding added."""
    return results.filter(F.col(ROW) < n)


register_mode("one_to_all", Mode(lambda f, n, mesh: everywhere(f, n), lambda r, mesh: in_order(r.filter(F.col(RANK) == 0))))
register_mode("all_to_all", Mode(lambda f, n, mesh: everywhere(f, n), lambda r, mesh: in_order(r)))
register_mode("dp_compute", Mode(lambda f, n, mesh: chunked(f, n), lambda r, mesh: in_order(r)))
register_mode("nd_compute", Mode(lambda f, n, mesh: over_mesh(f, mesh), first_of_mesh))


def dispatched(f: SampleFrame, mode: str, ranks: int, work: Callable[[DataFrame], DataFrame], mesh: dict[int, int] | None = None) -> DataFrame:
    """Rows out by the mode, the work on rows that know their rank, and back, without what padding added."""
    m, n = get_mode(mode), f.count()
    done = m.back(work(m.out(f, ranks, mesh)), mesh)
    return unpadded(done, n * ranks if mode == "all_to_all" else n)


def rank_shards(df: DataFrame, key: str, ranks: int, size: int, seed: int, epoch: int = 0) -> DataFrame:
    """rank, batch, place and key of a shuffled loader: rows in the order of a hash of seed and epoch go to ranks in turn,
    in batches of ``size``; what doesn't fill a batch of every rank is dropped."""
    line = with_row_id(df.select(key, F.xxhash64(F.lit(seed), F.lit(epoch), key).alias("_h")), ["_h", key], "_n")
    whole = line.agg(F.expr(f"count(*) div {ranks * size} * {ranks * size}")).first()[0]
    return line.filter(F.col("_n") < whole).select((F.col("_n") % ranks).cast("int").alias(RANK), F.expr(f"_n div {ranks * size}").alias("batch"), F.expr(f"_n div {ranks} % {size}").alias("place"), key)


def curriculum(df: DataFrame, group: str, score: str, floor: float = 0.05) -> DataFrame:
    """group, weight: the share in which groups are drawn next, by how far their mean score is from sure (0 or 1)."""
    g = df.groupBy(group).agg(F.avg(score).alias("_m"))
    w = g.withColumn("_w", F.greatest(F.col("_m") * (1 - F.col("_m")) * 4, F.lit(floor)))
    return w.crossJoin(F.broadcast(w.agg(F.sum("_w").alias("_all")))).select(group, (F.col("_w") / F.col("_all")).alias("weight"))


def global_sizes(df: DataFrame) -> DataFrame:
    """rank, n, before: rows of each rank, and those of the ranks before it."""
    g = df.groupBy(RANK).agg(F.count("*").alias("n"))
    return g.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(RANK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a rank


# --- queries ---
_MESH = {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def _frame(spark, sf_dir) -> SampleFrame:
    return SampleFrame.of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_orderkey"])


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("by", F.col(RANK))


def x19_chunked(spark, sf_dir):
    """Seven ranks, whose rows do not divide: which rank had which row."""
    return dispatched(_frame(spark, sf_dir), "dp_compute", 7, _marked).select(ROW, "o_orderkey", "by")


def x18_everywhere(spark, sf_dir):
    return dispatched(_frame(spark, sf_dir), "all_to_all", 3, _marked).select(ROW, "o_orderkey", "by")


def x18_one_answer(spark, sf_dir):
    return dispatched(_frame(spark, sf_dir), "one_to_all", 3, _marked).select(ROW, "o_orderkey", "by")


def x21_mesh(spark, sf_dir):
    """Six ranks of three data-parallel numbers: two of each see its rows, the first one answers."""
    return dispatched(_frame(spark, sf_dir), "nd_compute", 6, _marked, _MESH).select(ROW, "o_orderkey", "by")


def x21_seen(spark, sf_dir):
    """What every rank of the mesh sees, before any of them answers."""
    return get_mode("nd_compute").out(_frame(spark, sf_dir), 6, _MESH).groupBy(RANK).agg(F.count("*").alias("n"), F.min(ROW).alias("first"), F.max(ROW).alias("last"))


def t23_rank_shards(spark, sf_dir):
    """What a shuffled loader must keep: full batches, no row twice, the number dropped."""
    s = rank_shards(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", 4, 64, 7)
    per = s.groupBy(RANK, "batch").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"))
    return per.groupBy(RANK).agg(F.count("*").alias("batches"), F.min("n").alias("least"), F.max("places").alias("most")).crossJoin(s.agg(F.count_distinct("o_orderkey").alias("rows")))


def t19_curriculum(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ok", (F.col("l_returnflag") == "R").cast("double"))
    return curriculum(li, "l_linenumber", "ok").withColumn("weight", F.round("weight", 8))


def u22_gathered(spark, sf_dir):
    """Sizes and offsets of the ranks, as a gather needs them."""
    return global_sizes(chunked(_frame(spark, sf_dir).slice(0, -3), 5))


QUERIES = {f.__name__: f for f in (x18_everywhere, x18_one_answer, x19_chunked, x21_mesh, x21_seen, t23_rank_shards, t19_curriculum, u22_gathered)}
_N = "o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)"
ORACLES = {
    "x19_chunked": f"WITH {_N} SELECT r AS row_id, o_orderkey, CAST(r // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS by FROM o",
    "x18_everywhere": f"WITH {_N} SELECT k * n + r AS row_id, o_orderkey, k::INT AS by FROM o, range(3) t(k)",
    "x18_one_answer": f"WITH {_N} SELECT r AS row_id, o_orderkey, 0::INT AS by FROM o",
    "x21_mesh": f"WITH {_N} SELECT r AS row_id, o_orderkey, CAST(2 * (r // CAST(ceil(n / 3.0) AS BIGINT)) AS INT) AS by FROM o",
    "x21_seen": "WITH c AS (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) AS s FROM orders) SELECT k::INT AS rank, s AS n, k // 2 * s AS first, (k // 2 + 1) * s - 1 AS last FROM c, range(6) t(k)",
    "t23_rank_shards": "SELECT k::INT AS rank, count(*) // 256 AS batches, 64::BIGINT AS least, 64::BIGINT AS most, count(*) // 256 * 256 AS rows FROM orders, range(4) t(k) GROUP BY k",
    "t19_curriculum": "WITH m AS (SELECT l_linenumber, avg((l_returnflag = 'R')::INT) AS m FROM lineitem GROUP BY 1), w AS (SELECT l_linenumber, greatest(m * (1 - m) * 4, 0.05) AS w FROM m) SELECT l_linenumber, round(w / sum(w) OVER (), 8) AS weight FROM w",
    "u22_gathered": "WITH c AS (SELECT CAST(ceil((count(*) - 3) / 5.0) AS BIGINT) AS s FROM orders) SELECT k::INT AS rank, s AS n, k * s AS before FROM c, range(5) t(k)",
}

"""Layout by sequence length: k-way balanced partitions, token-budget batches and their inverse.

Within a batch the partition is a small combinatorial problem over (row, length) pairs; batches are independent, so tasks
take many of them at a time, sorted.  A batch is one training batch and is bounded by its size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def workload(length: Column) -> Column:
    """Relative cost of a sequence: linear layers and attention."""
    return 24576 * length + length * length


def _members(tree) -> list[int]:
    """Leaves of nested pairs."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        elif x is not None:
            out.append(x)
    return sorted(out)


def differencing(lengths: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing method: states of k bins merge in the order of their spread, largest against smallest.

    With ``equal_size`` all bins hold as many members; the count must divide.  Ties go to lower indices, so runs agree.
    Bins hold links to the bins that they come from; members are gathered once, at the end.
    """
    n = len(lengths)
    if k <= 0 or n < k:
        raise ValueError(f"{n} sequences don't make {k} partitions")
    if equal_size and n % k:
        raise ValueError(f"{n} sequences don't make {k} equal partitions")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    groups = [order[i : i + k] for i in range(0, n, k)] if equal_size else [[i] for i in order]
    heap, number = [], 0
    for g in groups:
        bins = sorted([(lengths[i], i, i) for i in g] + [(0, n, None)] * (k - len(g)), key=lambda b: (-b[0], b[1]))
        heap.append((bins[-1][0] - bins[0][0], number, bins))
        number += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        bins = sorted(((x + y, min(i, j), (p, q)) for (x, i, p), (y, j, q) in zip(a, reversed(b), strict=True)), key=lambda t: (-t[0], t[1]))
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], number, bins))
        number += 1
    return sorted((_members(tree) for _, _, tree in heap[0][2]), key=lambda p: p[:1])


def in_order(lengths: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each sequence, in input order, to the least loaded bin (that has room)."""
    room = len(lengths) // k if equal_size else len(lengths)
    parts, load = [[] for _ in range(k)], [0] * k
    for i, x in enumerate(lengths):
        best = min((j for j in range(k) if len(parts[j]) < room), key=lambda j: (load[j], j))
        parts[best].append(i)
        load[best] += x
    return parts


def zigzag(members: Sequence[int], cost: Sequence[float]) -> list[int]:
    """Cheap ones at both ends: of the descending order every second one, backwards, then the others.

    Ties go to the higher index first, as the descending order does.
    """
    ranked = sorted(members, key=lambda i: (cost[i], i), reverse=True)
    return ranked[::2][::-1] + ranked[1::2]


def bins_needed(total: int, budget: int, at_least: int = 1, multiple: int = 1) -> int:
    n = max(at_least, -(-total // budget))
    return -(-n // multiple) * multiple


def by_batch(use: DataFrame, assign: Callable[[list[int], list[int], int], Iterable[tuple[int, int, int]]], names: Sequence[str]) -> DataFrame:
    """batch, row and two numbers (named) that ``assign`` gives for the rows, lengths and k of each batch of ``use``.

    A batch becomes one row first, so whatever the planner does to the tasks, none gets a part of it.
    """
    schema = f"batch long, row long, {names[0]} int, {names[1]} int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group, rows, lengths, k = b.columns
            cut, row, length = (c.to_numpy(zero_copy_only=False) for c in (rows.offsets, rows.values, lengths.values))
            out = [(g, *x) for g, lo, hi, n in zip(group.to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), k.to_pylist(), strict=True) for x in assign(row[lo:hi].tolist(), length[lo:hi].tolist(), n)]
            parts = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["batch", "row", *names])

    grouped = use.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("_l"), F.first("k").alias("k"))
    return grouped.select("batch", F.col("_l.row").alias("row"), F.col("_l.length").alias("length"), "k").mapInArrow(run, schema)


def balanced(df: DataFrame, batch: str, row: str, length: str, k: int, equal_size: bool = True) -> DataFrame:
    """(batch, row, partition, place): each batch's rows balanced over k partitions, in zigzag order within each.

    Without ``equal_size`` a batch of fewer rows than k gets a partition a row.
    """
    use = df.select(F.col(batch).cast("long").alias("batch"), F.col(row).cast("long").alias("row"), F.col(length).cast("long").alias("length"), F.lit(k).alias("k"))

    def assign(rows: list[int], x: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        cost = [24576 * v + v * v for v in x]
        for p, part in enumerate(differencing(cost, k if equal_size else min(k, len(rows)), equal_size)):
            yield from ((rows[i], p, at) for at, i in enumerate(zigzag(part, cost)))

    return by_batch(use, assign, ["partition", "place"])


def dealt_in_order(df: DataFrame, batch: str, row: str, length: str, k: int) -> DataFrame:
    """(batch, row, partition, length): each batch's rows, in their order, to the least loaded of k partitions."""
    use = df.select(F.col(batch).cast("long").alias("batch"), F.col(row).cast("long").alias("row"), F.col(length).cast("long").alias("length"), F.lit(k).alias("k"))

    def assign(rows: list[int], x: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        for p, part in enumerate(in_order(x, k)):
            yield from ((rows[i], p, x[i]) for i in part)

    return by_batch(use, assign, ["partition", "length"])


def token_batches(df: DataFrame, batch: str, row: str, length: str, budget: int, *, at_least: int = 1, multiple: int = 1, step: str | None = None, ordered: bool = True) -> DataFrame:
    """(batch, row, micro_batch, place): as few micro batches as the token budget asks, balanced by workload.

    Their number is at most that of the rows, at least ``at_least``, and then rounded up to a ``multiple``; more than there
    are rows raises.  Batches with an equal ``step`` (the ranks of one step) get as many, the most that any of them needs.
    With ``ordered`` small micro batches stand at both ends.  The budget is on the mean: balancing keeps every micro batch
    near it, as the number of bins is its only constraint.  ``place`` is the row's place in its micro batch.
    """
    use = df.select(F.col(batch).cast("long").alias("batch"), F.col(row).cast("long").alias("row"), F.col(length).cast("long").alias("length"), (F.col(step) if step else F.lit(None)).alias("step"))
    sizes = use.groupBy("batch").agg(F.first("step").alias("step"), F.count("*").alias("n"), F.sum("length").alias("total"), F.max("length").alias("most"))
    own = F.greatest(F.lit(at_least).cast("long"), F.least("n", F.ceil(F.col("total") / budget)))
    sizes = sizes.withColumn("k", F.max(own).over(Window.partitionBy("step")) if step else own).withColumn("k", F.ceil(F.col("k") / multiple) * multiple)
    long = F.raise_error(F.format_string(f"a sequence of %d tokens exceeds the budget of {budget}", "most")).cast("long")
    few = F.raise_error(F.format_string("%d rows don't make %d micro batches", "n", "k")).cast("long")
    sizes = sizes.select(F.col("batch").alias("_batch"), F.when(F.col("most") > budget, long).when(F.col("k") > F.col("n"), few).otherwise(F.col("k")).alias("k"))

    def assign(rows: list[int], x: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        cost = [24576 * v + v * v for v in x]
        parts = differencing(cost, k)
        load = [sum(cost[i] for i in p) for p in parts]
        for at, p in enumerate(zigzag(range(k), load) if ordered else range(k)):
            yield from ((rows[i], at, place) for place, i in enumerate(parts[p]))

    return by_batch(use.join(sizes, F.col("batch") == F.col("_batch")), assign, ["micro_batch", "place"])


def packed(df: DataFrame, batch: str, micro: str, place: str, row: str, tokens: str) -> DataFrame:
    """A row a micro batch without padding: values (all tokens back to back), offsets (one more than rows) and rows."""
    item = F.struct(F.col(place).alias("place"), F.col(row).alias("row"), F.col(tokens).alias("tokens"))
    g = df.groupBy(batch, micro).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    ends = F.aggregate("_l", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.size(x["tokens"])))
    return g.select(batch, micro, F.flatten(F.col("_l.tokens")).alias("values"), ends.alias("offsets"), F.col("_l.row").alias("rows"))


def unpacked(df: DataFrame, row: str, out: str, *, values: str = "values", offsets: str = "offsets", rows: str = "rows") -> DataFrame:
    """The rows of packed micro batches again, each with its stretch of the values; their order is that of ``row``."""
    each = df.select(values, offsets, F.posexplode(rows).alias("_p", row))
    start = F.get(F.col(offsets), F.col("_p"))
    return each.select(row, F.slice(F.col(values), start + 1, F.get(F.col(offsets), F.col("_p") + 1) - start).alias(out))


def inverse(df: DataFrame, frm: str = "old", to: str = "new") -> DataFrame:
    """The inverse of a permutation that is given as a table of positions."""
    return df.select(F.col(to).alias(frm), F.col(frm).alias(to))


def imbalance(assigned: DataFrame, part: str, length: str) -> DataFrame:
    """One row: smallest, largest and mean sum of lengths of the parts, and the difference."""
    s = assigned.groupBy(part).agg(F.sum(length).alias("s"))
    return s.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.avg("s").alias("mean"))


# --- queries: line items as sequences, batches of 64 orders ---
def _sequences(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.expr("o_orderkey div 64").alias("batch"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 500 + 10).alias("length"))


def t15_workload(spark, sf_dir):
    return _sequences(spark, sf_dir).select("row", workload(F.col("length")).alias("workload"))


def _balanced(spark, sf_dir) -> DataFrame:
    """Full batches in partitions of equal size, incomplete ones by workload alone."""
    s = _sequences(spark, sf_dir)
    sized = s.join(s.groupBy("batch").count(), "batch")
    full, rest = (balanced(sized.filter(f"count {op} 64"), "batch", "row", "length", 8, equal_size=op == "=") for op in ("=", "<>"))
    return full.union(rest)


def _loads(done: DataFrame, spark, sf_dir, part: str) -> DataFrame:
    """batch, part, n, load and the least and the largest workload of the rows."""
    s = _sequences(spark, sf_dir).select("row", workload(F.col("length")).alias("w"), "length")
    return done.join(s, "row").groupBy("batch", part).agg(F.count("*").alias("n"), F.sum("w").alias("load"), F.max("w").alias("top"), F.sum("length").alias("tokens"))


def t09_balanced(spark, sf_dir):
    """What partitions must keep: every row once, eight of them, of eight rows in full batches, loads near each other."""
    p = _loads(_balanced(spark, sf_dir), spark, sf_dir, "partition")
    even = (F.max("load") - F.min("load") <= F.max("top")) | (F.sum("n") < 64)
    return p.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("partitions"), F.when(F.sum("n") == 64, F.max("n") - F.min("n")).otherwise(0).alias("unequal"), F.sum("tokens").alias("tokens"), even.alias("even"))


def t09_placed(spark, sf_dir):
    """The order within partitions: places are dense, and the workload rises and then falls."""
    s = _sequences(spark, sf_dir).select("row", workload(F.col("length")).alias("w"))
    g = _balanced(spark, sf_dir).join(s, "row").groupBy("batch", "partition").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("l"))
    return g.select("batch", "partition", "l", _rises_then_falls(F.col("l.w")).alias("up_down"), (F.col("l.place") == F.sequence(F.lit(0), F.size("l") - 1)).alias("dense")).groupBy("batch").agg(F.bool_and("up_down").alias("up_down"), F.bool_and("dense").alias("dense"))


def _rises_then_falls(x: Column) -> Column:
    state = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("fell"), F.lit(True).alias("ok"))
    step = lambda a, v: F.struct(v.alias("last"), (a["fell"] | F.coalesce(v < a["last"], F.lit(False))).alias("fell"), (a["ok"] & ~(a["fell"] & F.coalesce(v > a["last"], F.lit(False)))).alias("ok"))
    return F.aggregate(x, state, step)["ok"]


def t12_token_batches(spark, sf_dir):
    """What micro batches must keep: their number, every row once, loads that rise and then fall and are near each other."""
    done = token_batches(_sequences(spark, sf_dir), "batch", "row", "length", 4096)
    p = _loads(done, spark, sf_dir, "micro_batch")
    g = p.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("micro_batches"), F.sum("tokens").alias("tokens"), (F.max("load") - F.min("load") <= F.max("top")).alias("even"), F.sort_array(F.collect_list(F.struct("micro_batch", "load"))).alias("l"))
    return g.select("batch", "n", "micro_batches", "tokens", "even", _rises_then_falls(F.col("l.load")).alias("up_down"))


def t13_same_count(spark, sf_dir):
    """Four batches are the ranks of a step and get as many micro batches, in multiples of two, three at least."""
    s = _sequences(spark, sf_dir)
    # a batch of few rows is a step of its own, as no batch can have more micro batches than rows
    sized = s.join(s.groupBy("batch").agg(F.count("*").alias("c")), "batch")
    large = sized.filter("c >= 16").withColumn("step", F.expr("batch div 4"))
    small = sized.filter("c < 16").withColumn("step", F.col("batch"))
    done = token_batches(large, "batch", "row", "length", 2048, at_least=3, multiple=2, step="step").union(token_batches(small, "batch", "row", "length", 2048, step="step"))
    return done.groupBy("batch").agg(F.count_distinct("micro_batch").alias("micro_batches"), F.count_distinct("row").alias("rows"))


def t14_restored(spark, sf_dir):
    """Token arrays packed by micro batch without padding, then restored to their rows."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tokens = li.groupBy(F.col("l_orderkey").alias("row")).agg(F.sort_array(F.collect_list("l_partkey")).alias("tokens"))
    s = tokens.select(F.expr("row div 64").alias("batch"), "row", F.size("tokens").alias("length"), "tokens")
    done = token_batches(s, "batch", "row", "length", 64).join(tokens, "row")
    back = unpacked(packed(done, "batch", "micro_batch", "place", "row", "tokens"), "row", "tokens")
    return back.select("row", F.array_join("tokens", ",").alias("tokens"))


def t26_inverse(spark, sf_dir):
    """Rows in the order of their micro batches, put back by the inverse of that order."""
    from .frame import ROW, SampleFrame, with_row_id

    done = token_batches(_sequences(spark, sf_dir), "batch", "row", "length", 4096)
    dealt = with_row_id(done, ["batch", "micro_batch", "place"]).select(ROW, "row")
    old = with_row_id(done.select("row"), ["row"], "old")
    order = dealt.join(old, "row").select("old", F.col(ROW).alias("new"))
    return SampleFrame(dealt).reorder(inverse(order)).df.select(F.col(ROW).alias("position"), "row")


def a28_chunk_imbalance(spark, sf_dir):
    return imbalance(_sequences(spark, sf_dir), "batch", "length").withColumn("mean", F.round("mean", 4))


QUERIES = {f.__name__: f for f in (t15_workload, t09_balanced, t09_placed, t12_token_batches, t13_same_count, t14_restored, t26_inverse, a28_chunk_imbalance)}
_SEQ = "(SELECT o_orderkey // 64 AS batch, o_orderkey AS row, o_custkey % 500 + 10 AS length FROM orders)"
ORACLES = {
    "t15_workload": f"SELECT row, 24576 * length + length * length AS workload FROM {_SEQ}",
    "t09_balanced": f"SELECT batch, count(*) AS n, least(count(*), 8) AS partitions, 0::BIGINT AS unequal, CAST(sum(length) AS BIGINT) AS tokens, true AS even FROM {_SEQ} GROUP BY 1",
    "t09_placed": f"SELECT DISTINCT batch, true AS up_down, true AS dense FROM {_SEQ}",
    "t12_token_batches": f"SELECT batch, count(*) AS n, CAST(ceil(sum(length) / 4096.0) AS BIGINT) AS micro_batches, CAST(sum(length) AS BIGINT) AS tokens, true AS even, true AS up_down FROM {_SEQ} GROUP BY 1",
    "t13_same_count": f"WITH b AS (SELECT batch, batch // 4 AS step, count(*) AS rows, greatest(3, least(count(*), ceil(sum(length) / 2048.0))) AS k FROM {_SEQ} GROUP BY 1 HAVING count(*) >= 16) SELECT batch, CAST(ceil(max(k) OVER (PARTITION BY step) / 2) * 2 AS BIGINT) AS micro_batches, rows FROM b UNION ALL SELECT batch, CAST(greatest(1, least(count(*), ceil(sum(length) / 2048.0))) AS BIGINT), count(*) FROM {_SEQ} GROUP BY 1 HAVING count(*) < 16",
    "t14_restored": "SELECT l_orderkey AS row, string_agg(l_partkey, ',' ORDER BY l_partkey) AS tokens FROM lineitem GROUP BY 1",
    "t26_inverse": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey AS row FROM orders",
    "a28_chunk_imbalance": f"SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff, round(avg(s), 4) AS mean FROM (SELECT batch, sum(length) AS s FROM {_SEQ} GROUP BY 1)",
}

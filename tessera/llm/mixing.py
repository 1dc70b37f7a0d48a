"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document falls, by a seeded hash of its key and text, into one of its source's blocks: a random subset.
2. Targets: the weights share all words; no target is above ``max_repeats`` times its source's size, and what is over
   goes to the others by weight until none is above.
3. A source's blocks are permuted, and drawn in that order again and again.  Its quota is the number of draws that reach
   its target; within the last of them documents are cut off by the seeded order.
4. The splitting tree deals the quotas to output shards: at every node the counts by source of one half are a draw from
   the multivariate hypergeometric distribution; leaves are shards.  Shards hold disjoint runs of each source's draws, and
   a document is taken once for each draw of its block that some shard holds; shards are shuffled locally by a seeded hash.

Blocks and sources are tables.  With many sources the tree deals quotas to groups of ``GROUP`` sources first, which is what
the driver holds, and every group's tree then goes on in a task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.frame import with_row_id

from .common import discard, free_name, written

#: The cycle of weights by source order.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources of a group, and entries (sources x shards) of the plan up to which it is broadcast: 16 MB of 64-bit numbers.
GROUP = 4096
BROADCAST_ENTRIES = 1 << 21
BLOCK_DOCS = 64
#: Documents that may fill the gap at the cut of a source.
FILLERS = 16
#: A source has at most two to this many blocks; blocks are of about equal size.
BLOCK_BITS = 13


def word_count(text):
    """Number of maximal runs of other characters than blank and \\t-\\r; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], max_repeats: float = 3.0) -> list[float]:
    """Share sum(sizes) by weight; cap each at ``max_repeats`` times its size; reshare the excess until none is above."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > max_repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * share
            break
        for i in over:
            out[i] = max_repeats * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int | list[int], takes: np.ndarray | None = None) -> np.ndarray:
    """Deal the quotas (draws by source) to shards: an array shards x sources whose columns sum to the quotas.

    ``takes`` are the draws of each shard, even ones if not given.
    """
    quotas = np.asarray(quotas, np.int64)
    if takes is None:
        takes = np.diff(int(quotas.sum()) * np.arange(shards + 1) // shards)
    before = np.r_[0, np.cumsum(takes)]
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas)]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*np.atleast_1d(seed), lo, hi])
        left = rng.multivariate_hypergeometric(counts, int(before[mid] - before[lo]), method="marginals") if len(counts) else counts
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


def _cut(g: pd.DataFrame) -> pd.DataFrame:
    """Where the edge block of a source is cut: the last hash of those taken in order, and the few that fill the rest."""
    g = g.sort_values("_h")
    size, hashes, room = g["_n"].to_numpy(), g["_h"].to_numpy(), float(g["_room"].iloc[0])
    k = int(np.searchsorted(np.cumsum(size), room, side="right"))
    room -= float(size[:k].sum())
    fill = []
    for i in sorted(range(k, len(size)), key=lambda i: (-size[i], hashes[i])):
        if 0 < size[i] <= room and len(fill) < FILLERS:
            fill.append(int(hashes[i]))
            room -= float(size[i])
    over = [i for i in range(k, len(size)) if 0 < size[i] < 2 * room and int(hashes[i]) not in fill]
    if over:  # one more is nearer to the target than none
        fill.append(int(hashes[min(over, key=lambda i: (abs(size[i] - room), hashes[i]))]))
    return pd.DataFrame({"_li": [int(g["_i"].iloc[0])], "_last": [int(hashes[k - 1]) if k else None], "_fill": [fill]}).astype({"_last": "Int64"})


def _with_targets(sources: DataFrame, weights, max_repeats: float) -> DataFrame:
    """``targets`` for a table of sources (i, n): adds goal.  A round is a sum over the table, until no share changes."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    cap = F.lit(float(max_repeats)) * F.col("n")
    share, held = None, -1
    while True:
        full = F.lit(False) if share is None else weight * F.lit(share) > cap
        r = sources.filter("n > 0").agg(F.sum("n").alias("all"), F.sum(F.when(full, F.col("n"))).alias("full"), F.sum(full.cast("long")).alias("capped"), F.sum(F.when(~full, weight)).alias("w")).first()
        if r["capped"] == held or not r["w"]:
            break
        held, share = r["capped"], (float(r["all"] or 0) - max_repeats * float(r["full"] or 0)) / r["w"]
    free = weight * F.lit(float(share or 0.0))
    goal = cap if share is None or not r["w"] else F.least(free, cap)
    return sources.withColumn("goal", F.when(F.col("n") > 0, goal).otherwise(0.0))


def _dealt(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """i, starts, drawn: for the quotas (i, quota) the first draw of every shard, and the draws that all shards hold."""
    grouped = quotas.withColumn("g", F.expr(f"i div {GROUP}"))
    totals = sorted(tuple(r) for r in grouped.groupBy("g").agg(F.sum("quota")).collect())  # a row a group
    top = splitting_tree(np.array([t for _, t in totals], np.int64), shards, seed)
    takes = quotas.sparkSession.createDataFrame([(g, top[:, k].tolist()) for k, (g, _) in enumerate(totals)], "g long, takes array<long>")

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        out = splitting_tree(rows["quota"].to_numpy(), shards, [seed, int(rows["g"].iloc[0])], np.array(rows["takes"].iloc[0]))
        starts = np.cumsum(out, axis=0) - out  # disjoint runs of each source's draws
        return pd.DataFrame({"i": rows["i"].to_numpy(), "starts": starts.T.tolist(), "drawn": out.sum(axis=0)})

    return grouped.join(takes, "g").groupBy("g").applyInPandas(deal, "i long, starts array<long>, drawn long")


def mix_names(columns: list[str]) -> dict[str, str]:
    """The names of ``mix``'s own columns beside ``columns``: size, source_size, target, copies, copy, shard, rank."""
    return {k: free_name(f"mix_{k}", columns) for k in ("size", "source_size", "target", "copies", "copy", "shard", "rank")}


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, max_repeats: float = 3.0, shards: int = 64, seed: int = 17) -> DataFrame:
    """A row for each document and each time that the mix takes it (one row with ``mix_copy`` null where it takes none).

    Columns: all of ``docs`` and those of ``mix_names``: mix_size, mix_source_size, mix_target, mix_copies (times taken),
    mix_copy (from 1), mix_shard and mix_rank (sorting by both gives the mixed order).  Sources go by code point, null
    last; weights repeat.  A document without words is never taken.  Rows that are equal in key and text share their fate;
    null keys are keys; an empty table gives no rows; columns of ``docs`` are kept under their names, whatever they are.
    A document is taken ``max_repeats`` times at most, rounded up where that is no whole number.  Texts are counted whole at
    any length.
    """
    spark, names = docs.sparkSession, mix_names(docs.columns)
    src, block = F.col(f"`{source}`").cast("string"), 1 << BLOCK_BITS

    def drawn_hash(k: Column, t: Column) -> Column:
        return F.xxhash64(F.lit(seed), k, t.cast("string"))

    def fine(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - BLOCK_BITS).cast("int")

    sums = written(docs.select(src.alias("s"), fine(drawn_hash(F.col(f"`{key}`"), F.col(f"`{text}`"))).alias("b"), word_count(F.col(f"`{text}`")).alias("n")).groupBy("s", "b").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "mix-blocks")
    totals = written(sums.groupBy("s").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "mix-sources")
    named = totals.filter("s is not null")
    numbered = with_row_id(named, ["s"], "i").unionByName(totals.filter("s is null").withColumn("i", F.lit(named.count()).cast("long")))
    every = max(1, int(totals.agg(F.sum("n")).first()[0] or 0))
    # blocks of about equal size, of BLOCK_DOCS documents at least on average; the permutation is by an odd step
    share = F.ceil(F.log2(F.greatest(F.lit(1.0), F.lit(float(block)) * F.col("n") / F.lit(float(every)))))
    bits = F.least(F.lit(BLOCK_BITS), share, F.floor(F.log2(F.greatest(F.lit(1.0), F.col("docs") / BLOCK_DOCS)))).cast("int")
    sources = _with_targets(written(numbered, "mix-numbered"), weights, max_repeats).withColumns({"bits": bits, "whole": F.when(F.col("n") > 0, F.floor(F.col("goal") / F.col("n"))).otherwise(0), "step": F.xxhash64(F.lit(seed), "i").bitwiseAND(block - 1).bitwiseOR(1)})
    sources = sources.withColumn("rest", F.col("goal") - F.col("whole") * F.col("n"))
    place = lambda c: F.expr(f"pmod({c} * step, shiftleft(1L, bits))")
    coarse = sums.select("s", "b", F.col("n").alias("words")).join(sources.select("s", "i", "bits", "step", "rest"), sums["s"].eqNullSafe(sources["s"])).withColumn("c", F.expr(f"shiftright(b, {BLOCK_BITS} - bits)"))
    coarse = coarse.withColumn("p", place("c")).groupBy("i", "p", "rest").agg(F.sum("words").alias("words"))
    ends = coarse.withColumn("end", F.sum("words").over(Window.partitionBy("i").orderBy("p")))  # 2^BLOCK_BITS rows a source at most
    edges = ends.filter("rest > 0 and end > rest").groupBy("i").agg(F.min(F.struct("p", (F.col("rest") - F.col("end") + F.col("words")).alias("room"))).alias("e")).select(F.col("i").alias("ei"), F.col("e.p").alias("edge"), F.col("e.room").alias("room"))
    quota = F.expr("whole * shiftleft(1L, bits) + coalesce(edge + 1, 0)")
    plan = written(sources.join(edges, F.col("i") == F.col("ei"), "left").drop("ei").withColumn("quota", quota), "mix-plan")
    dealt = written(_dealt(plan.select("i", "quota"), shards, seed).withColumnRenamed("i", "_di"), "mix-deal")
    planned = plan.join(dealt, plan["i"] == dealt["_di"]).select(F.col("s").alias("_s"), F.col("i").alias("_i"), F.col("bits").alias("_bits"), F.col("n").alias("_total"), F.col("goal").alias("_goal"), F.col("edge").alias("_edge"), F.col("room").alias("_room"), F.col("quota").alias("_quota"), F.col("step").alias("step"), F.col("starts").alias("_starts"), F.col("drawn").alias("_drawn"))
    if plan.count() * shards <= BROADCAST_ENTRIES:  # else Spark chooses by the plan's size
        planned = F.broadcast(planned)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), src.alias("_own"), drawn_hash(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("_h"))
    rows = rows.join(planned, F.col("_own").eqNullSafe(F.col("_s"))).withColumn("_p", F.expr(f"pmod(shiftright(cast(shiftrightunsigned(_h, {64 - BLOCK_BITS}) as int), {BLOCK_BITS} - _bits) * step, shiftleft(1L, _bits))"))
    # in the last draw of a source documents are taken in hash order while they fit; then others fill what is left
    edge = rows.filter("_p = _edge").select("_i", "_h", "_room", word_count(F.col(f"_row.`{text}`")).alias("_n")).groupBy("_i", "_h").agg(F.sum("_n").alias("_n"), F.first("_room").alias("_room"))
    last = written(edge.groupBy("_i").applyInPandas(_cut, "_li long, _last long, _fill array<long>"), "mix-edges")
    if plan.count() * FILLERS <= BROADCAST_ENTRIES:
        last = F.broadcast(last)
    each = rows.join(last, F.col("_i") == F.col("_li"), "left").withColumn("_n", word_count(F.col(f"_row.`{text}`")))
    draws = "if(_drawn > _p, cast(floor((_drawn - 1 - _p) / shiftleft(1L, _bits)) as int) + 1, 0)"
    cut_off = "if(_p = _edge and _drawn = _quota and not (coalesce(_h <= _last, false) or coalesce(array_contains(_fill, _h), false)), 1, 0)"
    each = each.withColumn("_copies", F.expr(f"if(_n > 0, greatest({draws} - {cut_off}, 0), 0)"))
    each = each.withColumn("_copy", F.explode(F.expr("if(_copies > 0, sequence(1, _copies), array(cast(null as int)))")))
    each = each.withColumn("_draw", F.expr("cast(_copy - 1 as long) * shiftleft(1L, _bits) + _p"))
    each = each.withColumn("_shard", F.expr("if(_copy is null, null, aggregate(_starts, 0, (a, x) -> a + if(x <= _draw, 1, 0)) - 1)"))
    rank = F.when(F.col("_copy").isNotNull(), F.xxhash64(F.lit(seed + 1), "_h", "_copy"))
    own = {"size": F.col("_n"), "source_size": F.col("_total"), "target": F.col("_goal"), "copies": F.col("_copies"), "copy": F.col("_copy"), "shard": F.col("_shard"), "rank": rank}
    discard(sums, totals)
    return each.select("_row.*", *[c.alias(names[k]) for k, c in own.items()])


def write_shards(mixed: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Write the taken rows as Parquet, a folder a shard, each shuffled locally by its rank.

    ``names`` are those of ``mix_names`` for the mixed documents' columns, where some of these are called like mix's own.
    """
    names = names or mix_names([])
    copy, shard, rank = (F.col(f"`{names[k]}`") for k in ("copy", "shard", "rank"))
    mixed.filter(copy.isNotNull()).repartition(shard).sortWithinPartitions(shard, rank).write.partitionBy(names["shard"]).parquet(path)

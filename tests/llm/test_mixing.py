"""The mix against a plain one that draws permuted blocks one by one, and against a tree that deals nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def table(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    texts = [" ".join(["w"] * int(k)) + f" d{i}" * int(k > 0) for i, k in enumerate(rng.integers(0, 40, n))] + [None, "", " \t"]
    sources = ["a", "a", "a", "b", None, "ç", "a"]
    rows = [(None if i % 50 == 3 else i // 2, t, sources[i % 7], i) for i, t in enumerate(texts)]
    rows += rows[:5]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy long")


def plain(rows, seed, shards, dealt, targets, weights, cap):
    """Times taken and shards of each (source, hash), by drawing blocks one after the other."""
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in names}
    goals = targets([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], cap)
    taken, quotas = {}, []
    for i, s in enumerate(names):
        own = [r for r in rows if r["source"] == s]
        bits = min(13, max(0, math.ceil(math.log2(max(1.0, 8192 * size[s] / sum(size.values()))))), int(math.log2(max(1.0, len(own) / 64))))
        block = lambda r, bits=bits: ((r["h"] % 2**64 >> 51) >> (13 - bits)) * r["step"] % 2**bits
        whole, words, draw = int(goals[i] // size[s]) if size[s] else 0, 0.0, 0
        words = whole * size[s]
        draw = whole << bits
        while words < goals[i]:  # the permuted blocks, until the target is reached in one
            p = draw % 2**bits
            got = sum(r["size"] for r in own if block(r) == p)
            if words + got > goals[i]:
                draw += 1
                break
            words += got
            draw += 1
        quotas.append(draw)
        for r in own:
            full = [d for d in range(draw) if d % 2**bits == block(r)]
            cut = draw - 1 if goals[i] > whole * size[s] else None
            taken[s, r["h"]] = (full, cut)
    starts = np.cumsum(dealt(np.array(quotas), shards), axis=0)
    return names, goals, taken, [[int(np.searchsorted(starts[:, i], d, side="right")) for d in range(q)] for i, q in enumerate(quotas)]


@pytest.mark.parametrize("cap", [3.0, 2.5])
def test_against_drawing_block_by_block(spark, monkeypatch, cap):
    from tessera.llm import mixing

    df, shards = table(spark), 5
    names = mixing.mix_names(df.columns)
    assert names["copy"] == "mix_copy_" and names["size"] == "mix_size"
    h = df.select("source", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), mixing.word_count(F.col("text")).alias("size")).collect()
    order = sorted({r["source"] for r in h}, key=lambda s: (s is None, (s or "").encode()))
    steps = {s: spark.range(1).select(F.xxhash64(F.lit(17), F.lit(i).cast("long")).bitwiseAND(8191).bitwiseOR(1)).first()[0] for i, s in enumerate(order)}
    rows = [{"source": r["source"], "h": r["h"], "size": r["size"], "step": steps[r["source"]]} for r in h]

    def dealt(quotas, shards):
        top = mixing.splitting_tree(np.array([quotas.sum()]), shards, 17)
        return mixing.splitting_tree(quotas, shards, [17, 0], top[:, 0])

    _, goals, taken, where = plain(rows, 17, shards, dealt, mixing.targets, mixing.WEIGHTS, cap)
    got = mixing.mix(df, shards=shards, max_repeats=cap).withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).collect()
    words = dict.fromkeys(order, 0)
    for r in got:
        i = order.index(r["source"])
        assert r[names["target"]] == pytest.approx(goals[i])
        full, cut = taken[r["source"], r["h"]]
        copies = r[names["copies"]]
        if r[names["size"]] == 0:
            assert copies == 0 and r[names["copy"]] is None
            continue
        assert copies in ({len(full), len(full) - 1} if cut in full else {len(full)}) and copies <= math.ceil(cap)
        if r[names["copy"]] is None:
            assert copies == 0
        else:
            assert r[names["shard"]] == where[i][full[r[names["copy"]] - 1]]
            words[r["source"]] += r[names["size"]]
    for i, s in enumerate(order):  # the two halves of equal rows share their fate, so a miss may be two documents
        assert abs(words[s] - goals[i]) <= 41
    again = mixing.mix(df, shards=shards, max_repeats=cap).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(str(tuple(r[:-1])) for r in got)
    # a tree that deals nothing takes nothing
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, shards, seed, takes=None: np.zeros((shards, len(q)), np.int64))
    assert mixing.mix(df, shards=shards, max_repeats=cap).filter(F.col(names["copies"]) > 0).isEmpty()


def test_many_sources_need_no_bound(spark, monkeypatch):
    from tessera.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 10)
    df = spark.range(600).select("id", F.concat(F.lit("s"), F.col("id") % 60).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 23).cast("int")).alias("text"))
    got = mixing.mix(df, key="id", shards=3).collect()
    sizes = {}
    for r in got:
        if r["mix_copy"] in (None, 1):
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix_size"]
    order = sorted(sizes)
    goals = mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(60)])
    for s, goal in zip(order, goals):
        own = [r for r in got if r["source"] == s]
        assert own[0]["mix_source_size"] == sizes[s] and own[0]["mix_target"] == pytest.approx(goal)
        assert abs(sum(r["mix_size"] for r in own if r["mix_copy"]) - goal) <= 22
    assert mixing.mix(df.limit(0), key="id").collect() == []


def test_shards_are_written_where_columns_clash(spark, tmp_path):
    """A user's own mix_shard, mix_copy and mix_rank columns stay, and decide nothing."""
    from tessera.llm.mixing import mix, mix_names, write_shards

    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], 99, -1, 0.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_shard int, mix_copy int, mix_rank double")
    names = mix_names(docs.columns)
    mixed = mix(docs, shards=4)
    write_shards(mixed, f"{tmp_path}/out", names)
    got = spark.read.parquet(f"{tmp_path}/out")
    taken = mixed.filter(f"`{names['copy']}` is not null")
    assert got.count() == taken.count() > 0 and {r[0] for r in got.select(names["shard"]).distinct().collect()} <= {0, 1, 2, 3}
    assert got.filter("mix_shard = 99 and mix_copy = -1").count() == got.count()

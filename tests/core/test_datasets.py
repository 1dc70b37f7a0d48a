"""Datasets by split, templates, batches for generation, pairs, masks, settings, scoring; lines of files; BLEU; repetition."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import conversations, repetition
from tessera.plans import datasets as D
from tessera.session import shared_path
from tessera.sources import tables


def test_positional_splits(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)], "k int")
    got = [(r["k"], r["index"], r["split"]) for r in D.positional(df, ["k"], {"a": 0.4, "b": 0.2, "c": 0.4}).orderBy("k").collect()]
    assert got == [(1, 0, "a"), (3, 1, "a"), (5, 2, "b"), (7, 3, "c"), (9, 4, "c")]
    assert D.positional(df.limit(0), ["k"], {"a": 1.0}).collect() == []
    with pytest.raises(ValueError, match="sum to 1"):
        D.positional(df, ["k"], {"a": 0.5})


def test_templates_and_system_turns(spark):
    turns = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "u")], "p"), (2, [("user", "v")], None), (3, None, "q")], f"k int, m {turns}, t string")
    got = {r["k"]: r["x"] for r in D.templated(df, "m", "x", lambda m: D.chat_text(m, True, "S")).collect()}
    assert got == {1: "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n", 2: "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nv<|im_end|>\n<|im_start|>assistant\n", 3: None}
    assert [r["x"] for r in D.templated(df, "t", "x", lambda m: D.chat_text(m, False)).orderBy("k").collect()] == ["<|im_start|>user\np<|im_end|>\n", None, "<|im_start|>user\nq<|im_end|>\n"]
    with pytest.raises(TypeError, match="no text and no turns"):
        D.templated(df, "k", "x", lambda m: m)
    parts = df.select(D.template_parts(lambda m, g: D.chat_text(m, g, "S")).alias("p")).first()["p"]
    assert tuple(parts) == ("<|im_start|>system\nS<|im_end|>\n", "<|im_start|>assistant\n")
    assert [len(r[0]) for r in df.filter("k < 3").select(D.with_system(F.col("m"), "x")).collect()] == [2, 2]


def test_batches_for_generation_and_built_ones(spark):
    df = spark.createDataFrame([(0, [1], "r", "s", 7)], "row_id long, input_ids array<int>, raw string, data_source string, uid int")
    gen, rest = D.generation_batch(df, "row_id", ["input_ids"])
    assert gen.columns == ["row_id", "input_ids", "raw"] and rest.columns == ["row_id", "data_source", "uid"]
    assert D.generation_batch(df, "row_id", ["input_ids"], for_agents=True)[0].columns == ["row_id", "input_ids", "raw", "data_source", "uid"]
    with pytest.raises(ValueError, match="has no"):
        D.generation_batch(df, "row_id")
    a, b = df.select("row_id", "raw"), df.select(F.col("row_id") + 1, "uid").toDF("row_id", "uid")
    with pytest.raises(ValueError, match="not the same rows"):
        D.built({"raw": a, "uid": b})
    with pytest.raises(TypeError, match="must come as"):
        D.built({"other": a})


def test_pairs_masks_and_settings(spark):
    df = spark.createDataFrame([(1, "a bb", "ccc", ""), (2, "", None, "d e f g h i")], "k int, p string, c string, r string")
    enc = lambda texts: [[len(w) for w in t.split()] for t in texts]
    got = {r["k"]: (r["input_ids"], r["attention_mask"]) for r in D.stacked_pairs(df, "p", "c", "r", enc, 5, end=9).collect()}
    assert got == {1: ([[1, 2, 3, 9, 0], [1, 2, 9, 0, 0]], [[1, 1, 1, 1, 0], [1, 1, 1, 0, 0]]), 2: ([[9, 0, 0, 0, 0], [1, 1, 1, 1, 1]], [[1, 0, 0, 0, 0], [1] * 5])}
    rows = spark.range(400)
    masks = [r["attention_mask"] for r in D.random_masks(rows, "id", 12, most=0.5, left=0.25, least=0.25, seed=3).collect()]
    text = ["".join(map(str, m)) for m in masks]
    assert all(3 <= t.count("1") <= 6 and "01" not in t.lstrip("0") and t.index("1") <= 3 for t in text) and len(set(text)) == 16
    with pytest.raises(ValueError, match="do not fit"):
        D.random_masks(rows, "id", 12, most=0.9, left=0.5)
    a, b = spark.createDataFrame([("x", 1), ("y", None)], "key string, value int"), spark.createDataFrame([("y", None), ("z", 3)], "key string, value int")
    assert sorted(map(tuple, D.merged_settings(a, b).collect())) == [("x", 1), ("y", None), ("z", 3)]
    with pytest.raises(Exception, match="two values of y"):
        D.merged_settings(a, b.fillna(5)).collect()


def test_scoring_in_chunks_and_at_a_pace(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(f):
        seen.add(1 if len(f) <= 4 else 100)
        return [None if x == 3 else float(x) for x in f["v"]]

    df = spark.createDataFrame([(i, i % 3 + 1) for i in range(10)], "v int, len int").coalesce(1)
    got = {r["v"]: r["rm_scores"] for r in D.chunked_scores(df, ["v"], score, "len", 3, size=4).collect()}
    assert got[3] is None and got[4] == [0.0, 4.0, 0.0] and got[5] == [0.0, 0.0, 5.0] and seen.value == 3
    e = spark.createDataFrame([(i, 10 if i == 2 else 1) for i in range(6)], "i int, tokens int")
    assert [round(r["at"], 3) for r in D.paced(e, ["i"], "tokens", requests_per_second=2, tokens_per_second=4).orderBy("i").collect()] == [0.0, 0.5, 1.0, 3.0, 3.25, 3.5]


def test_lines_are_numbered_whatever_the_splits(spark):
    path = shared_path(spark, "lines")
    spark.range(3000).select(F.to_json(F.struct("id", F.lit("a-1").alias("s"), F.array("id").alias("l"))).alias("value"), (F.col("id") % 2).alias("f")).repartition("f").sortWithinPartitions("f", "value").write.partitionBy("f").text(path)
    want = None
    for size in ("134217728", "4000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        lines = tables.numbered_lines(spark, path)
        got = sorted(map(tuple, lines.collect()))
        assert lines.rdd.getNumPartitions() >= 1
        by_file = Counter(f for f, _, _ in got)
        assert all([i for f, i, _ in got if f == g] == list(range(n)) for g, n in by_file.items())
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    seen = tables.viewed_rows(lines, "id long, s string, l array<long>", mask=r"\d").filter("id = '7'").first()
    assert (seen["s"], seen["l"]) == ("a-*", "[7]")


def plain_bleu(c, r, order=4):
    if not c:
        return 0.0
    logs = 0.0
    for k in range(1, order + 1):
        a, b = (Counter(x[i : i + k] for i in range(len(x) - k + 1)) for x in (c, r))
        hit = sum((a & b).values())
        if k == 1 and not hit:
            return 0.0
        logs += math.log((hit or conversations.TINY) / max(1, len(c) - k + 1)) / order
    return math.exp(logs) * (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c)))


def test_bleu(spark):
    rng = np.random.default_rng(2)
    pairs = [("", ""), ("a", ""), ("", "a"), ("abcdef", "abcdef"), ("xyz", "abc"), ("ab", "ab"), ("aaaa", "aa"), (None, "a"), ("é€x", "x€é")]
    pairs += [("".join(rng.choice(list("ab c"), int(rng.integers(1, 60)))), "".join(rng.choice(list("ab c"), int(rng.integers(1, 60))))) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, c string, r string")
    for r in conversations.bleu(df, "k", "c", "r").collect():
        assert r["bleu"] == pytest.approx(plain_bleu(*(x or "" for x in pairs[r["k"]])), abs=1e-12)


def test_metrics_that_fail_count_zero(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "abcd")], "abcd"), (2, [], "x"), (3, None, None)], "k int, m array<struct<role: string, content: string>>, t string")
    got = {r["k"]: tuple(r)[1:] for r in conversations.conversation_metrics(df, "k", "m", "t", ["bleu_score", "turns", "nothing"]).collect()}
    assert got == {1: (pytest.approx(1.0), 2.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    told = spark.createDataFrame([('{"thought": "t", "final_completion": "x"}',), ('{"final_completion": "x"}',), ("no",), (None,)], "t string")
    assert [r[0] for r in told.select(conversations.final_completion(F.col("t"))).collect()] == ["x", None, None, None]


def plain_prefixes(t):
    s = sorted(t[i:] for i in range(len(t)))
    return sum(next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(s, s[1:], strict=False))


def test_prefix_sums():
    rng = np.random.default_rng(4)
    texts = ["", "a", "aa", "abcabcabc", "é€é€", "a" * 300, "\U0001f600" * 5] + ["".join(rng.choice(list("ab"), int(rng.integers(0, 40)))) for _ in range(200)]
    assert repetition.prefix_sums(texts).tolist() == [plain_prefixes(t) for t in texts]
    long = "the quick brown fox " * 30_000
    assert repetition.shares([long, None, "xy"])[0] > 0.9

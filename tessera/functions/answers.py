"""Answer extraction, normalization and grading as column expressions; Arrow UDFs only for what is no regular language."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Only the end of a solution is searched for its answer.
TAIL_CHARS = 300

#: Replacements and removals of the answer normalizer, in order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED_EXPRESSIONS = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots"]


#: Patterns of the answer normalizer and what stands for them, in order.
UNWRAPPED = ((r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"), (r"\\overline\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}"))
#: Replacements of the LaTeX clean-up, in order.
LATEX_REPLACED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: an expression that is used twice would stand twice in the plan, and a chain of
    such steps doubles at each."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def where(x: Column, mark: str, f: Callable[[Column], Column]) -> Column:
    """f of a text that holds ``mark``, any other text as it is: a pattern costs far more than a look for what it needs."""
    return let(x, lambda v: F.when(v.contains(mark), f(v)).otherwise(v))


def tail(text: Column, n: int = TAIL_CHARS) -> Column:
    return F.when(F.char_length(text) > n, F.substring(text, -n, n)).otherwise(text)


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


# --- marked numbers ---
def marked_number(text: Column, method: str = "strict") -> Column:
    """strict: the last number after ####, without commas; flexible: the last number that is not a lone point (if all
    are, the first)."""
    t = tail(text)
    if method == "strict":
        return F.regexp_replace(last_match(t, r"#### (\-?[0-9\.\,]+)"), "[,$]", "")
    if method == "flexible":
        found = F.regexp_extract_all(t, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
        return let(found, lambda x: F.coalesce(F.try_element_at(F.filter(x, lambda v: ~v.isin("", ".")), F.lit(-1)), F.try_element_at(x, F.lit(1))))
    raise ValueError(f"no such method: {method}")


def first_marked_number(text: Column) -> Column:
    """The first number after ####, without commas; none raises."""
    got = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    return F.when(got == "", F.raise_error(F.lit("no marked answer")).cast("string")).otherwise(F.regexp_replace(got, ",", ""))


def number_score(text: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    return let(marked_number(text, method), lambda got: F.when(got.isNull(), 0.0).when(got == truth, score).otherwise(format_score))


# --- boxed answers ---
def _last_from(text: Column, mark: str) -> Column:
    """The text from the last ``mark`` on; null without one."""
    behind = F.char_length(F.substring_index(text, mark, -1)) + len(mark)
    return F.when(text.contains(mark), F.substring(text, F.char_length(text) - behind + 1, behind))


def boxed(text: Column) -> Column:
    """The last \\boxed or else \\fbox with balanced braces; "\\boxed x$" gives "\\boxed x".  A fold over its braces."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(a: Column, piece: Column) -> Column:  # a piece ends with a brace, but for the last
        depth = a["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        upto = a["upto"] + F.char_length(piece)
        closed = (a["end"] == 0) & piece.rlike(r"(?s)[{}]$") & (depth == 0)
        return F.struct(upto.alias("upto"), depth.alias("depth"), F.when(closed, upto).otherwise(a["end"]).alias("end"))

    def cut(start: Column) -> Column:
        return let(F.aggregate(F.split(start, r"(?<=[{}])"), zero, step)["end"], lambda end: F.when(end > 0, F.substring(start, F.lit(1), end)))

    def of(x: Column) -> Column:
        spaced = F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(x, "\\boxed ", -1), "$", 1))
        start = F.coalesce(_last_from(x, "\\boxed"), _last_from(x, "\\fbox"))
        return F.when(x.contains("\\boxed "), spaced).when(x.contains("\\boxed") | x.contains("\\fbox"), let(start, cut))

    return let(text, of)


def unboxed(box: Column) -> Column:
    """The content of \\boxed{...} or \\boxed ...; any other shape is null."""
    some = lambda x: let(x, lambda v: F.when(v != "", v))
    return let(box, lambda b: F.coalesce(some(F.regexp_extract(b, r"(?s)^\\boxed (.*)$", 1)), some(F.regexp_extract(b, r"(?s)^\\boxed\{(.*)\}$", 1))))


def _latex_cleaned(text: Column) -> Column:
    for a, b in LATEX_REPLACED:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = where(text, "\\text{ ", lambda v: F.regexp_replace(v, r"(?s)\\text\{ .*$", ""))
    for a, b in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = where(text, ".", lambda v: F.regexp_replace(v, r"^\.", "0."))
    text = where(text, "=", lambda v: F.regexp_replace(v, r"^[^=]{0,2}=([^=]*)$", "$1"))
    text = where(text, "\\sqrt", lambda v: F.regexp_replace(v, r"\\sqrt([^{])", r"\\sqrt{$1}"))
    return F.replace(text, F.lit(" "), F.lit(""))


def _latex_fractions(text: Column) -> Column:
    def full(x: Column) -> Column:
        both = F.regexp_replace(F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
        return F.when(x.rlike(r"\\frac[^{]$"), x).otherwise(both)

    return where(text, "\\frac", full)


def _latex_quotients(x: Column) -> Column:
    half = F.when(x == "0.5", "\\frac{1}{2}").otherwise(x)
    return where(half, "/", lambda v: F.regexp_replace(v, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}"))


#: Clean-up of short LaTeX answers: line breaks, sizes, degrees, units, percent, leading zero, fractions, roots, a/b.
LATEX_STEPS = (_latex_cleaned, _latex_fractions, _latex_quotients)


def latex_normalized(text: Column) -> Column:
    """All of ``LATEX_STEPS``, each on a value that is worked out once."""
    for step in LATEX_STEPS:
        text = let(text, step)
    return text


def latex_equal(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda t: F.coalesce(latex_normalized(t["a"]) == latex_normalized(t["b"]), t["a"].isNull() & t["b"].isNull()))


def boxed_score(text: Column, truth: Column) -> Column:
    return let(boxed(text), lambda b: F.when(b.isNotNull() & latex_equal(unboxed(b), truth), 1.0).otherwise(0.0))


# --- "Answer:" lines ---
def answer_normalized(answer: Column, *, after_equals: bool = True) -> Column:
    """Ordered replacements and removals, unwrapped text and boxes, full fractions and roots, numbers without commas."""
    x = F.element_at(F.split(answer, "="), -1) if after_equals else answer
    for a, b in SUBSTITUTIONS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for a in REMOVED_EXPRESSIONS:
        x = F.replace(x, F.lit(a), F.lit(""))
    for pattern, by in UNWRAPPED:
        x = F.regexp_replace(x, pattern, by)
    x = F.replace(x, F.lit("$"), F.lit(""))
    x = let(x, lambda v: F.when(F.replace(v, F.lit(","), F.lit("")).rlike("^[0-9]+$"), F.replace(v, F.lit(","), F.lit(""))).otherwise(v))
    return F.trim(x) if after_equals else x


def answer_line(text: Column) -> Column:
    return F.coalesce(last_match(text, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))


def answer_line_score(text: Column, truth: Column) -> Column:
    """A struct of score (1 or -1), acc and pred, from the end of the solution."""
    both = F.struct(answer_normalized(answer_line(tail(text))).alias("pred"), answer_normalized(truth).alias("truth"))
    return let(both, lambda t: F.struct(F.when(t["pred"] == t["truth"], 1.0).otherwise(-1.0).alias("score"), (t["pred"] == t["truth"]).alias("acc"), t["pred"].alias("pred")))


def strict_box_score(text: Column, truth: Column) -> Column:
    """1 if the box in the last 100 characters holds the truth, else -1."""
    return F.when(F.coalesce(unboxed(boxed(tail(text, 100))) == truth, F.lit(False)), 1.0).otherwise(-1.0)


# --- question answering ---
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def qa_normalized(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    x = F.translate(F.lower(text), _PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    return let(qa_normalized(prediction), lambda p: F.exists(golds, lambda g: qa_normalized(g) == p))


def substring_match(prediction: Column, golds: Column) -> Column:
    return let(qa_normalized(prediction), lambda p: F.exists(golds, lambda g: p.contains(qa_normalized(g))))


def tagged_answer(text: Column) -> Column:
    """The stripped content of the last <answer> element."""
    return F.regexp_replace(last_match(text, r"(?s)<answer>(.*?)</answer>"), r"^\s+|\s+$", "")


def tag_count(text: Column, tag: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def qa_score(text: Column, golds: Column, *, substring: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Exact (or substring) match of the tagged answer; over ten tags of a kind quarter the score."""
    match = substring_match if substring else exact_match
    many = (tag_count(text, "<answer>") > 10) | (tag_count(text, "</answer>") > 10)
    full = F.when(many & F.lit(not substring), score / 4).otherwise(score)
    return let(tagged_answer(text), lambda answer: F.when(answer.isNull(), 0.0).when(match(answer, golds), full).otherwise(format_score))


# --- small predicates and formats ---
def choice_score(text: Column, truth: Column) -> Column:
    """First "Answer: A" to "D" equals the truth."""
    return (F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1) == truth).cast("double")


def trimmed_equal(a: Column, b: Column) -> Column:
    return F.trim(a) == F.trim(b)


def number_or_null(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def format_reward(text: Column) -> Column:
    """1 if the whole text is a think element followed by a box."""
    return text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def think_parts(text: Column) -> Column:
    """Struct of thought and rest; null unless there is exactly one think element and neither part is blank."""
    thought, rest = F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)), F.trim(F.regexp_extract(text, r"(?s)</think>(.*)$", 1))
    ok = (tag_count(text, "<think>") == 1) & (tag_count(text, "</think>") == 1) & (thought != "") & (rest != "")
    return F.when(ok, F.struct(thought.alias("thought"), rest.alias("rest")))


def without_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def choice_index(text: Column, total: Column | int) -> Column:
    """The boxed integer if it lies in [-1, total), else null."""
    n = F.nullif(F.regexp_extract(text, r"\\boxed\{\s*(-?\d+)\s*\}", 1), F.lit("")).try_cast("int")
    return F.when((n >= -1) & (n < total), n)


def tool_calls(text: Column, schema: str = "name string, arguments map<string,string>") -> Column:
    """The parsed JSON of every <tool_call> element, without those that don't parse."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.from_json(x, schema)), lambda x: x.isNotNull() & x["name"].isNotNull())


#: A tool call and its end in channel markup.
CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>commentary to=functions\.([^<\s]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def channel_calls(text: Column) -> Column:
    """name and arguments (JSON) of every call in channel markup whose arguments are an object."""
    names, bodies = (F.regexp_extract_all(text, F.lit(CHANNEL_CALL), F.lit(i)) for i in (1, 2))
    both = F.zip_with(names, bodies, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))
    return F.filter(both, lambda c: F.from_json(c["arguments"], "map<string,string>").isNotNull() & F.get_json_object(c["arguments"], "$").isNotNull())


def without_channel_calls(text: Column) -> Column:
    return F.regexp_replace(text, CHANNEL_CALL, "")


def without_tool_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


def passages(docs: Column) -> Column:
    """Doc i (Title: first line) and the rest, for an array of texts."""
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(x, "\n", 1), F.lit(") "), F.regexp_replace(x, r"(?s)^[^\n]*\n?", ""), F.lit("\n"))
    return F.array_join(F.transform(docs, one), "")


def messages_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**: "), m["content"])), "\n")


def without_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def valid_messages(messages: Column) -> Column:
    return (F.size(messages) > 0) & F.forall(messages, lambda m: F.trim(m["content"]) != "")


def message_tokens(messages: Column, prompt_turns: Column) -> Column:
    """Blank-parted tokens of the messages after the prompt."""
    after = F.slice(messages, prompt_turns + 1, F.greatest(F.size(messages) - prompt_turns, F.lit(0)))
    return F.aggregate(after, F.lit(0), lambda a, m: a + F.when(F.trim(m["content"]) == "", 0).otherwise(F.size(F.split(F.trim(m["content"]), r"\s+"))))


def box_valid(box: Column) -> Column:
    """left < right, top < bottom, and no side over 100 times the other."""
    w, h = box[2] - box[0], box[3] - box[1]
    return F.coalesce((w > 0) & (h > 0) & (F.greatest(w, h) <= 100 * F.least(w, h)), F.lit(False))


def first_inside(points: Column, box: Column) -> Column:
    """Rank (from 1) of the first point within the box; 0 if none is."""
    return F.array_position(F.transform(points, lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3])), True)


# --- beyond regular languages ---
def _first_json(text: str | None) -> str | None:
    """The first balanced {...} or [...] that is JSON."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


def _tolerant_json(text: str | None) -> str | None:
    """JSON, or else what is left of it with single quotes, Python's constants, trailing commas and a code fence."""
    if text is None:
        return None
    if (found := _first_json(text)) is not None:
        return found
    body = re.sub(r"^\s*```(?:json)?|```\s*$", "", text)
    at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    out, quote, escaped = [], "", False
    for c in body[at:]:
        if quote:
            if escaped:
                out.append("'" if c == "'" else "\\" + c)
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                out.append('"')
                quote = ""
            else:
                out.append('\\"' if c == '"' else "\\n" if c == "\n" else c)
        elif c in "\"'":
            quote = c
            out.append('"')
        else:
            out.append(c)
    parts = re.split(r'("(?:[^"\\]|\\.)*")', "".join(out))  # strings stand at odd places
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", parts[i])))
    return _first_json(re.sub(r",(\s*[}\]])", r"\1", "".join(parts)))


@pandas_udf(T.StringType())
def tolerant_json(text: pd.Series) -> pd.Series:
    return text.map(_tolerant_json)


@pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    return text.map(_first_json)


def bleu(candidate: str, reference: str, order: int = 4) -> float:
    """Sentence BLEU of blank-parted tokens with add-one smoothing above unigrams."""
    import math
    from collections import Counter

    c, r = candidate.split(), reference.split()
    if not c or not r:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
        hit, total = sum((a & b).values()), max(1, sum(a.values()))
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit + (n > 1)) / (total + (n > 1))) / order
    return math.exp(logs) * min(1.0, math.exp(1 - len(r) / len(c)))


@pandas_udf(T.DoubleType())
def bleu_score(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([bleu(a or "", b or "") for a, b in zip(candidate, reference, strict=True)])


def collinear(points: Column) -> Column:
    """Whether any three of the points lie on a line."""
    n = F.size(points)
    at = lambda i: F.get(points, i)
    cross = lambda i, j, k: F.abs((at(j)["x"] - at(i)["x"]) * (at(k)["y"] - at(i)["y"]) - (at(k)["x"] - at(i)["x"]) * (at(j)["y"] - at(i)["y"])) <= 1e-9
    upto = lambda a: F.filter(F.sequence(F.lit(0), n), lambda x: (x > a) & (x < n))
    return F.exists(upto(F.lit(-1)), lambda i: F.exists(upto(i), lambda j: F.exists(upto(j), lambda k: cross(i, j, k))))


# --- queries ---
def _solutions(spark, sf_dir) -> DataFrame:
    """Orders as solutions of eight shapes, by key mod 8; every shape has its answer in another dress, one has none.

    0: #### with a thousands comma, an answer line in dollars, a box with a fraction;  1: two marks and two answer lines;
    2: a box within a box's braces, and an older box before it;  3: \\fbox;  4: "\\boxed x$";  5: no answer at all;
    6: an unclosed box, an answer line with units and a decimal;  7: null.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    number = F.concat(s(F.expr("o_orderkey div 1000")), F.lit(","), F.lpad(s(k % 1000), 3, "0"))
    said = F.concat(F.lit("<answer> The "), F.col("o_orderpriority"), F.lit("! </answer>"))
    shapes = [
        F.concat(F.lit("We add 3.5 and 7.\n#### "), number, F.lit("\nAnswer: $"), number, F.lit("$ dollars\nso \\boxed{\\frac{"), s(k), F.lit("}{2}} "), said),
        F.concat(F.lit("#### 7\nno, #### "), s(k), F.lit("\nAnswer: 3\nanswer :  x = "), s(k), F.lit(" km")),
        F.concat(F.lit("\\boxed{1} then \\boxed{\\sqrt{\\frac{"), s(k), F.lit("}{\\boxed{3}}}} "), said, F.lit("<answer>none of these</answer>")),
        F.concat(F.lit("so \\fbox{"), s(k), F.lit("\\%}")),
        F.concat(F.lit("so $\\boxed "), s(k), F.lit("$ or about.")),
        F.lit("I do not know."),
        F.concat(F.lit("\\boxed{"), s(k), F.lit(" {\nAnswer: "), s(k % 100), F.lit(".50 cm")),
    ]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(k % 8 == i, shape).otherwise(text)
    return o.withColumns({"text": text, "truth": s(k % 10_000), "golds": F.array(F.lit("none"), F.col("o_orderpriority"))})


def f01_marked_number(spark, sf_dir):
    return _solutions(spark, sf_dir).select("o_orderkey", marked_number(F.col("text")).alias("strict"), marked_number(F.col("text"), "flexible").alias("flexible"))


def f02_number_score(spark, sf_dir):
    return _solutions(spark, sf_dir).select("o_orderkey", number_score(F.col("text"), F.col("truth"), format_score=0.1).alias("score"))


def f09_answer_line(spark, sf_dir):
    line = _solutions(spark, sf_dir).select("o_orderkey", answer_line(F.col("text")).alias("line"))
    return line.select("o_orderkey", "line", answer_normalized(F.col("line")).alias("pred"))


def f13_answer_line_score(spark, sf_dir):
    return _solutions(spark, sf_dir).select("o_orderkey", answer_line_score(F.col("text"), F.col("truth")).alias("s")).select("o_orderkey", "s.*")


def f03_boxed(spark, sf_dir):
    return _solutions(spark, sf_dir).select("o_orderkey", boxed(F.col("text")).alias("box"), unboxed(boxed(F.col("text"))).alias("content"))


def f05_latex_equal(spark, sf_dir):
    """The boxed content against the same value in another dress, and against another value."""
    t = _solutions(spark, sf_dir).select("o_orderkey", unboxed(boxed(F.col("text"))).alias("content"))
    k = F.col("o_orderkey").cast("string")
    return t.select("o_orderkey", latex_equal(F.col("content"), F.concat(F.lit("\\dfrac{"), k, F.lit("}{ 2}"))).alias("half"), latex_equal(F.concat(F.lit("x="), k, F.lit(" \\text{ cm}")), k).alias("unit"), latex_equal(F.concat(k, F.lit("/3")), F.concat(F.lit("\\frac"), F.lit("{"), k, F.lit("}{3}"))).alias("third"), latex_equal(F.lit(".5"), F.lit("\\frac12")).alias("point"))


def f07_boxed_score(spark, sf_dir):
    t = _solutions(spark, sf_dir)
    return t.select("o_orderkey", boxed_score(F.col("text"), F.concat(F.lit("\\dfrac{"), F.col("o_orderkey").cast("string"), F.lit("}{2}"))).alias("score"), strict_box_score(F.col("text"), F.col("o_orderkey").cast("string")).alias("strict"))


def f28_format(spark, sf_dir):
    """Formats of thought and answer, and what is left without the thought."""
    t = _solutions(spark, sf_dir).select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "<think>so</think> ").when(F.col("o_orderkey") % 3 == 1, "<think> </think> ").otherwise("<think>a <think>b</think> "), "text").alias("t"))
    return t.select("o_orderkey", format_reward(F.col("t")).alias("reward"), think_parts(F.col("t"))["thought"].alias("thought"), F.char_length(without_think(F.col("t"))).alias("left"))


def f35_choice(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("Answer: $"), F.substring(F.lit("ABCDE"), F.col("o_orderkey").cast("int") % 5 + 1, F.lit(1)), F.lit("$ then answer: B")).alias("t"), F.concat(F.lit("so \\boxed{ "), (F.col("o_custkey") % 7 - 2).cast("string"), F.lit(" }")).alias("b"))
    return t.select("o_orderkey", choice_score(F.col("t"), F.lit("B")).alias("score"), choice_index(F.col("b"), 4).alias("choice"), number_or_null(F.concat(F.lit("1,"), F.regexp_extract("b", r"(-?\d+)", 1))).alias("number"))


def f43_first_json(spark, sf_dir):
    """The first JSON value behind a broken one; tolerant reading of quotes, constants and commas."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.concat(F.lit("see {broken, and "), "props", F.lit(" or [1]"))
    loose = F.concat(F.lit("{'user': "), F.col("user_id").cast("string"), F.lit(", 'ok': True, 'none': None, 'list': [1, 2,], }"))
    return e.select("event_id", F.get_json_object(first_json(t), "$.k").alias("k"), F.get_json_object(tolerant_json(loose), "$.user").alias("user"), F.get_json_object(tolerant_json(loose), "$.ok").alias("ok"), F.get_json_object(tolerant_json(loose), "$.list[1]").alias("second"))


def f52_channel_calls(spark, sf_dir):
    """Tool calls in channel markup, with a broken one, and the rest of the text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    call = lambda to, body: F.concat(F.lit("<|start|>assistant<|channel|>commentary to=functions."), to, F.lit(" <|constrain|>json<|message|>"), body, F.lit("<|call|>"))
    t = F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|>"), call(F.col("event_type"), F.col("props")), call(F.lit("other"), F.lit("{broken")), call(F.lit("last"), F.lit('{"k": 1}')))
    calls = channel_calls(t)
    return e.select("event_id", F.size(calls).alias("n"), calls[0]["name"].alias("first"), F.get_json_object(calls[0]["arguments"], "$.k").alias("k"), calls[1]["name"].alias("second"), without_channel_calls(t).alias("rest"))


def f53_passages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/benchmark.parquet").groupBy(F.expr("item_id div 8").alias("g")).agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("l"))
    titled = F.transform("l", lambda x: F.concat(F.lit("Title "), x["item_id"].cast("string"), F.lit("\n"), x["text"]))
    return c.select("g", F.md5(passages(titled)).alias("digest"))


def f82_points(spark, sf_dir):
    """Boxes and points from the orders: validity, the first point inside, and whether three stand in a line."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 50).cast("double").alias("x"), (F.col("o_orderkey") % 40).cast("double").alias("y"))
    box = F.array(F.col("x"), F.lit(5.0), F.lit(30.0), F.col("y"))
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    points = F.array(at(F.lit(40.0), F.lit(1.0)), at(F.lit(20.0), F.lit(10.0)), at(F.col("x"), F.col("y")))
    return o.select("o_orderkey", box_valid(box).alias("valid"), first_inside(points, box).alias("inside"), collinear(points).alias("line"))


def f22_qa_normalized(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", qa_normalized(F.col("text")).alias("normal"))


def f26_qa_score(spark, sf_dir):
    return _solutions(spark, sf_dir).select("o_orderkey", qa_score(F.col("text"), F.col("golds")).alias("exact"), qa_score(F.col("text"), F.array(F.lit("urgent")), substring=True).alias("part"))


def f33_trimmed_equal(spark, sf_dir):
    """Blanks on either side do not count; another status, an inner blank and a null do."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    one = F.concat(F.repeat(F.lit(" "), (k % 3).cast("int")), status, F.repeat(F.lit(" "), (k % 2).cast("int")))
    other = F.when(k % 5 == 0, "X").when(k % 5 == 1, F.concat(status, F.lit(" ."))).when(k % 5 == 2, F.lit(None).cast("string")).otherwise(F.concat(status, F.lit("  ")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", trimmed_equal(one, other).alias("same"))


def f46_message_tokens(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return m.select("conv_id", message_tokens(F.col("messages"), F.lit(1)).alias("tokens"), F.md5(messages_text(without_system(F.col("messages")))).alias("digest"))


def f51_props(spark, sf_dir):
    """None to three calls, of which the last is broken in some texts, and what is left of the text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = (F.col("event_id") % 4).cast("int")
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}</tool_call>"))
    t = F.concat(F.lit("ok "), F.repeat(call, n), F.when(F.col("event_id") % 3 == 0, "<tool_call>{broken</tool_call>").otherwise(""), F.lit(" then "), F.col("event_id").cast("string"))
    return e.select("event_id", F.get(tool_calls(t), F.lit(0))["name"].alias("name"), F.size(tool_calls(t)).alias("calls"), F.get(tool_calls(t), n - 1)["arguments"]["k"].alias("k"), without_tool_calls(t).alias("rest"))


QUERIES = {f.__name__: f for f in (f05_latex_equal, f07_boxed_score, f28_format, f35_choice, f43_first_json, f52_channel_calls, f53_passages, f82_points, f01_marked_number, f02_number_score, f09_answer_line, f13_answer_line_score, f03_boxed, f22_qa_normalized, f26_qa_score, f33_trimmed_equal, f46_message_tokens, f51_props)}
_BY = lambda *cases, other="NULL": "CASE " + " ".join(f"WHEN o_orderkey % 8 IN ({k}) THEN {v}" for k, v in cases) + f" ELSE {other} END"
_K = "o_orderkey::VARCHAR"
_COMMA = "(o_orderkey // 1000) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')"
_STRICT = _BY(("0", "replace(" + _COMMA + ", ',', '')"), ("1", _K))
_PRED = _BY(("0", "replace(" + _COMMA + ", ',', '')"), ("1", _K), ("2, 3, 4, 5", "'[INVALID]'"), ("6", "(o_orderkey % 100) || '.50'"))
_CONTENT = _BY(("0", r"'\frac{' || o_orderkey || '}{2}'"), ("2", "'3'"), ("4", _K))
_BOX = _BY(("0", r"'\boxed{\frac{' || o_orderkey || '}{2}}'"), ("2", r"'\boxed{3}'"), ("3", r"'\fbox{' || o_orderkey || '\%}'"), ("4", r"'\boxed ' || o_orderkey"))
ORACLES = {
    "f01_marked_number": f"SELECT o_orderkey, {_STRICT} AS strict, " + _BY(("0, 2", "o_orderpriority[1]"), ("1, 3, 4", _K), ("5", "'.'"), ("6", "(o_orderkey % 100) || '.50'")) + " AS flexible FROM orders",
    "f02_number_score": f"SELECT o_orderkey, CASE WHEN {_STRICT} IS NULL THEN 0.0 WHEN {_STRICT} = (o_orderkey % 10000)::VARCHAR THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM orders",
    "f09_answer_line": "SELECT o_orderkey, " + _BY(("0", "'$' || " + _COMMA + " || '$ dollars'"), ("1", "'x = ' || o_orderkey || ' km'"), ("2, 3, 4, 5", "'[INVALID]'"), ("6", "(o_orderkey % 100) || '.50 cm'"), other="'[INVALID]'") + f" AS line, coalesce({_PRED}, '[INVALID]') AS pred FROM orders",
    "f13_answer_line_score": f"WITH x AS (SELECT o_orderkey, coalesce({_PRED}, '[INVALID]') AS pred FROM orders) SELECT o_orderkey, CASE WHEN pred = (o_orderkey % 10000)::VARCHAR THEN 1.0 ELSE -1.0 END::DOUBLE AS score, pred = (o_orderkey % 10000)::VARCHAR AS acc, pred FROM x",
    "f03_boxed": f"SELECT o_orderkey, {_BOX} AS box, {_CONTENT} AS content FROM orders",
    "f05_latex_equal": "SELECT o_orderkey, o_orderkey % 8 = 0 AS half, true AS unit, true AS third, true AS point FROM orders",
    "f07_boxed_score": "SELECT o_orderkey, (o_orderkey % 8 = 0)::INT::DOUBLE AS score, CASE WHEN o_orderkey % 8 = 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS strict FROM orders",
    "f28_format": "WITH t AS (SELECT o_orderkey, " + _BY(("0", "'We add 3.5 and 7.' || chr(10) || '#### ' || " + _COMMA + " || chr(10) || 'Answer: $' || " + _COMMA + r" || '$ dollars' || chr(10) || 'so \boxed{\frac{' || o_orderkey || '}{2}} <answer> The ' || o_orderpriority || '! </answer>'"), ("1", "'#### 7' || chr(10) || 'no, #### ' || o_orderkey || chr(10) || 'Answer: 3' || chr(10) || 'answer :  x = ' || o_orderkey || ' km'"), ("2", r"'\boxed{1} then \boxed{\sqrt{\frac{' || o_orderkey || '}{\boxed{3}}}} <answer> The ' || o_orderpriority || '! </answer><answer>none of these</answer>'"), ("3", r"'so \fbox{' || o_orderkey || '\%}'"), ("4", r"'so $\boxed ' || o_orderkey || '$ or about.'"), ("5", "'I do not know.'"), ("6", r"'\boxed{' || o_orderkey || ' {' || chr(10) || 'Answer: ' || (o_orderkey % 100) || '.50 cm'")) + " AS x FROM orders) SELECT o_orderkey, CASE WHEN x IS NULL THEN NULL ELSE (o_orderkey % 8 IN (0, 2))::INT::DOUBLE END AS reward, CASE WHEN x IS NOT NULL AND o_orderkey % 3 = 0 THEN 'so' END AS thought, length(x)::INT AS left FROM t",
    "f35_choice": "SELECT o_orderkey, (o_orderkey % 5 = 1 OR o_orderkey % 5 = 4)::INT::DOUBLE AS score, CASE WHEN o_custkey % 7 - 2 BETWEEN -1 AND 3 THEN (o_custkey % 7 - 2)::INT END AS choice, CASE WHEN o_custkey % 7 >= 2 THEN (10 + o_custkey % 7 - 2)::DOUBLE END AS number FROM orders",
    "f43_first_json": "SELECT event_id, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS user, 'true' AS ok, '2' AS second FROM events",
    "f52_channel_calls": "SELECT event_id, 2::INT AS n, event_type AS first, json_extract_string(props, '$.k') AS k, 'last' AS second, '<|channel|>analysis<|message|>hm<|end|>' AS rest FROM events",
    "f53_passages": "WITH t AS (SELECT item_id // 8 AS g, item_id, text, row_number() OVER (PARTITION BY item_id // 8 ORDER BY item_id, text) AS i FROM benchmark) SELECT g, md5(string_agg('Doc ' || i || ' (Title: Title ' || item_id || ') ' || text || chr(10), '' ORDER BY i)) AS digest FROM t GROUP BY 1",
    "f82_points": "WITH t AS (SELECT o_orderkey, (o_custkey % 50)::DOUBLE AS x, (o_orderkey % 40)::DOUBLE AS y FROM orders), b AS (SELECT *, 30 - x AS w, y - 5 AS h FROM t) SELECT o_orderkey, w > 0 AND h > 0 AND greatest(w, h) <= 100 * least(w, h) AS valid, CASE WHEN 20 BETWEEN x AND 30 AND 10 BETWEEN 5 AND y THEN 2 WHEN x BETWEEN x AND 30 AND y BETWEEN 5 AND y THEN 3 ELSE 0 END::BIGINT AS inside, abs((20 - 40) * (y - 1) - (x - 40) * (10 - 1)) <= 1e-9 AS line FROM b",
    "f22_qa_normalized": r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')), '\s+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS normal FROM benchmark",
    "f26_qa_score": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE WHEN o_orderkey % 8 = 0 AND lower(o_orderpriority) LIKE '%urgent%' THEN 1.0 ELSE 0.0 END::DOUBLE AS part FROM orders",
    "f33_trimmed_equal": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_orderkey % 5 > 2 END AS same FROM orders",
    "f46_message_tokens": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, coalesce(sum(len(regexp_split_to_array(trim(text, ' '), '\\s+'))) FILTER (i > 1), 0)::INT AS tokens, md5(string_agg('**' || upper(role[1]) || lower(role[2:]) || '**: ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system')) AS digest FROM t GROUP BY 1",
    "f51_props": "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS name, (event_id % 4)::INT AS calls, CASE WHEN event_id % 4 > 0 THEN json_extract_string(props, '$.k') END AS k, 'ok  then ' || event_id AS rest FROM events",
}

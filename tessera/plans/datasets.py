"""Whole datasets: canonical tables by split, preference pairs as tensors, prompts for generation and continuation,
what a batch hands to generation, random masks, merged settings, chunked and paced scoring.

Each writer makes one table partitioned by split, so a reader of one split opens only its files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers
from ..functions.rewards import scattered, score_by_source, scorer
from ..operators.arrays import fixed_width
from ..operators.frame import ROW, with_row_id
from ..session import shared_path
from .curation import conversations, prompt_row, with_instruction
from .rows import Encode, encoded

#: The columns that stay with a batch for its reward, and the sources of graded tasks.
REWARD_KEYS = ("data_source", "reward_model", "extra_info", "uid")
scorer("Maxwell-Jia/AIME_2024", "opencompass/cnmo2024_en", "opencompass/cnmo2024_zh")(answers.boxed_score)
scorer("Idavidrein/gpqa")(answers.choice_score)


# --- tables by split ---
def positional(df: DataFrame, order: list[str], shares: dict[str, float], out: str = "split") -> DataFrame:
    """``df`` with index (its place in ``order``) and the split whose share of all rows that place falls into.

    Shares are taken in their order and sum to 1; the rows' number is counted, their contents stay where they are.
    """
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("the shares do not sum to 1")
    numbered = with_row_id(df, order, "index")
    n, upto, split = df.count(), 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        below = F.col("index") < int(n * upto + 1e-9)
        split = F.when(below, name) if split is None else split.when(below, name)
    last = list(shares)[-1]
    return numbered.withColumn(out, F.lit(last) if split is None else split.otherwise(last))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One table, a folder a split."""
    df.write.partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, column: str = "split") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(column) == split)


def tagged_union(parts: dict[str, DataFrame], column: str = "data_source") -> DataFrame:
    """All parts as one dataset, each tagged by its source."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(column, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


# --- prompts ---
def templated(df: DataFrame, prompt: str, out: str, render: Callable[[Column], Column]) -> DataFrame:
    """``df`` with the prompt as text: a list of turns is rendered, a string is taken as one user's turn; another type raises."""
    kind = df.schema[prompt].dataType
    if isinstance(kind, T.StringType):
        turns = F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"role", "content"} <= set(kind.elementType.names):
        turns = F.col(prompt)
    else:
        raise TypeError(f"{prompt} is {kind.simpleString()}, no text and no turns")
    return df.withColumn(out, F.when(F.col(prompt).isNotNull(), render(turns)))


def chat_text(messages: Column, generation: bool | Column = True, default_system: Column | str | None = None) -> Column:
    """Turns between im_start and im_end marks, the default system turn where none is given, and the assistant's start."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    body = F.array_join(F.transform(messages, turn), "")
    if default_system is not None:
        text = F.lit(default_system) if isinstance(default_system, str) else default_system
        own = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
        body = F.concat(F.when(own, "").otherwise(F.concat(F.lit("<|im_start|>system\n"), text, F.lit("<|im_end|>\n"))), body)
    start = F.lit("<|im_start|>assistant\n")
    return F.concat(body, start if generation is True else F.lit("") if generation is False else F.when(generation, start).otherwise(""))


def template_parts(render: Callable[[Column, bool], Column]) -> Column:
    """Struct of system and generation: what a template puts before all turns by itself, and before what is generated.

    Both are read off three renderings of empty user turns, by their lengths, so any template will do.
    """
    user = F.struct(F.lit("user").alias("role"), F.lit("").alias("content"))
    one, two, asked = render(F.array(user), False), render(F.array(user, user), False), render(F.array(user), True)
    turn = F.char_length(two) - F.char_length(one)
    return F.struct(F.substring(one, F.lit(1), F.char_length(one) - turn).alias("system"), F.substring(asked, F.char_length(one) + 1, F.char_length(asked)).alias("generation"))


def with_system(messages: Column, text: Column | str) -> Column:
    """Turns that begin with this system turn, in place of their own one if they have one."""
    system = F.struct(F.lit("system").alias("role"), (F.lit(text) if isinstance(text, str) else text).alias("content"))
    rest = F.filter(messages, lambda m: m["role"] != "system")
    return F.concat(F.array(system), rest)


def continuation_rows(df: DataFrame, question: str, start: str, instruction: str, needed: Sequence[str] = ()) -> DataFrame:
    """``df`` with prompt (the question with the instruction, unless it has it, and the start of an answer as turns) and
    prompt_chars.  Columns that are not there raise."""
    if missing := [c for c in (question, start, *needed) if c not in df.columns]:
        raise ValueError(f"the columns {missing} are missing")
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    rows = df.withColumn("_q", with_instruction(F.col(question), instruction))
    return rows.withColumns({"prompt": F.array(turn("user", F.col("_q")), turn("assistant", F.col(start))), "prompt_chars": F.char_length("_q") + F.char_length(start)}).drop("_q")


def generation_batch(df: DataFrame, row: str, tensors: Sequence[str] = ("input_ids", "attention_mask", "position_ids"), *, for_agents: bool = False) -> tuple[DataFrame, DataFrame]:
    """(generation, rest): the tensors and all columns that no reward needs go to generation, the others stay; agents get all.

    Both sides have ``row``, by which they are joined again.
    """
    held = [c for c in df.columns if c in REWARD_KEYS]
    others = [c for c in df.columns if c not in (*held, *tensors, row)]
    if missing := [c for c in tensors if c not in df.columns]:
        raise ValueError(f"the batch has no {missing}")
    return df.select(row, *tensors, *others, *(held if for_agents else [])), df.select(row, *held)


def built(columns: dict[str, DataFrame], row: str = ROW) -> DataFrame:
    """One batch of columns that come as tables of (``row``, column): all must have the same rows, else this raises."""
    sizes = {name: tuple(df.agg(F.count("*"), F.count_distinct(row), F.bit_xor(F.xxhash64(row))).first()) for name, df in columns.items()}
    if len(set(sizes.values())) > 1 or any(n != d for n, d, _ in sizes.values()):
        raise ValueError(f"the columns have not the same rows: {({k: v[0] for k, v in sizes.items()})}")
    out = None
    for name, df in columns.items():
        if sorted(df.columns) != sorted([row, name]):
            raise TypeError(f"{name} must come as {row} and {name}")
        out = df if out is None else out.join(df, row)
    return out


# --- pairs as tensors ---
def stacked_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, encode: Encode, width: int, *, end: int | None = None, pad: int = 0) -> DataFrame:
    """``df`` with input_ids and attention_mask of two rows each: prompt and chosen, prompt and rejected (and the end token),
    cut and padded on the right to ``width``."""
    rows = encoded(df, (prompt, chosen, rejected), encode, ("_p", "_c", "_r"))
    tail = F.array(*([F.lit(end).cast("long")] if end is not None else [])).cast("array<long>")
    both = F.array(*[F.concat("_p", side, tail) for side in ("_c", "_r")])
    rows = rows.withColumn("_ids", both)
    ids = F.transform("_ids", lambda x: fixed_width(x, width, pad, left=False, how="right"))
    mask = F.transform("_ids", lambda x: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= F.size(x)).cast("int")))
    return rows.withColumns({"input_ids": ids, "attention_mask": mask}).drop("_p", "_c", "_r", "_ids")


def uniform(row: Column, seed: int, kind: str) -> Column:
    """A number in [0, 1) of a row's key, a seed and a kind: the first 32 bits of a digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(kind), row.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32


def random_masks(df: DataFrame, row: str, width: int, *, most: float, left: float, least: float = 0.0, seed: int = 0, out: str = "attention_mask") -> DataFrame:
    """Masks with a random left padding and number of ones within the given shares of the width; zeros behind."""
    high, low, pads = int(width * most), max(1, int(width * least)), int(width * left)
    if not (0 < most <= 1 and 0 <= left < 1 and least <= most and high > 0 and high + pads <= width):
        raise ValueError("the shares do not fit the width")
    rows = df.withColumns({"_pad": F.floor(uniform(F.col(row), seed, "pad") * (pads + 1)), "_n": low + F.floor(uniform(F.col(row), seed, "valid") * (high - low + 1))})
    return rows.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: ((i >= F.col("_pad")) & (i < F.col("_pad") + F.col("_n"))).cast("int"))).drop("_pad", "_n")


def merged_settings(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Two tables of settings as one; a key that both have must have the same value, else this raises."""
    both = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(F.col(key).alias("_k"), F.col(value).alias("_b")), F.col(key) == F.col("_k"), "full")
    fits = F.when(F.col("_in_a").isNull() | F.col("_k").isNull() | F.col("_a").eqNullSafe(F.col("_b")), F.when(F.col("_in_a"), F.col("_a")).otherwise(F.col("_b")))
    return both.select(F.coalesce(key, "_k").alias(key), fits.otherwise(F.raise_error(F.concat(F.lit("two values of "), key)).cast(a.schema[value].dataType)).alias(value))


# --- scoring ---
def chunked_scores(df: DataFrame, columns: Sequence[str], score: Callable[[pd.DataFrame], Sequence[float]], length: str, width: int, *, size: int, out: str = "rm_scores") -> DataFrame:
    """``df`` with the score of a model that takes chunks of at most ``size`` rows, at the last token's place.

    A chunk never crosses a task; a row's score may not depend on its chunk.  A null score is kept as null.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            use, scores = f[list(columns)], []
            for at in range(0, len(f), size):
                scores += list(score(use.iloc[at : at + size]))
            yield f.assign(_score=scores)[[*names, "_score"]]

    done = df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("_score", T.DoubleType())]))
    return done.withColumn(out, F.when(F.col("_score").isNotNull(), scattered(F.col("_score"), F.col(length), F.lit(width)))).drop("_score")


def paced(df: DataFrame, order: list[str], tokens: str, *, requests_per_second: float, tokens_per_second: float, out: str = "at") -> DataFrame:
    """``df`` with the second at which each request may start, for all executors together: those before it, at the pace of
    requests and at that of tokens.  Sums come from ``with_row_id`` and cells, so no task sees all rows."""
    from ..operators.frame import running

    numbered = with_row_id(df, order, "_i").withColumn("_cell", F.expr("_i div 4096"))
    sums = running(numbered.groupBy("_cell").agg(F.sum(tokens).alias("_t")), "_cell", "_t", "_base").select(F.col("_cell").alias("_c"), "_base")
    inside = F.coalesce(F.sum(tokens).over(Window.partitionBy("_cell").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce("_base", F.lit(0)) + F.col("_own")
    joined = numbered.withColumn("_own", inside).join(sums, F.col("_cell") == F.col("_c"))
    return joined.withColumn(out, F.greatest(F.col("_i") / requests_per_second, before / tokens_per_second)).drop("_i", "_cell", "_c", "_base", "_own")


def boxed_truth(text: Column) -> Column:
    """1 where the last box of a judge's answer says True."""
    return F.coalesce((answers.unboxed(answers.boxed(text)) == "True").cast("double"), F.lit(0.0))


# --- queries ---
STEP_BY_STEP = "Please reason step by step, and put your final answer within \\boxed{}."


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def s28_split_tables(spark, sf_dir):
    """Prompt rows of orders, the last tenth as test split, written by split and read one split after the other."""
    path = shared_path(spark, "splits")
    o = positional(_orders(spark, sf_dir), ["o_orderkey"], {"train": 0.9, "test": 0.1})
    question = F.concat(F.trim("o_orderpriority"), F.lit("\n\n"))
    rows = o.select("split", "index", *prompt_row(source="math-dapo", question=question, ability="Math", truth=F.col("o_custkey").cast("string"), split="-", index=F.col("index"), suffix=STEP_BY_STEP))
    write_splits(rows, path)
    out = read_split(spark, path, "test").unionByName(read_split(spark, path, "train"))
    return out.select("split", "index", "data_source", "ability", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.col("reward_model.ground_truth").alias("truth"))


def p25_pair_splits(spark, sf_dir):
    """Preferences, three quarters to train, and both splits' sizes and ends."""
    path = shared_path(spark, "pairs")
    o = positional(_orders(spark, sf_dir).select("o_orderkey", F.col("o_orderpriority").alias("prompt"), F.concat(F.lit("good "), "o_custkey").alias("chosen"), F.lit("bad").alias("rejected")), ["o_orderkey"], {"train": 0.75, "test": 0.25})
    write_splits(o, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count_distinct("chosen").alias("chosen"))


def p26_model_rows(spark, sf_dir):
    o = with_row_id(_orders(spark, sf_dir), ["o_orderkey"], "index")
    rows = o.select(*prompt_row(source="hh", question=F.col("o_orderpriority"), ability="alignment", truth=F.col("o_orderstatus"), split="train", index=F.col("index"), style="model"))
    return rows.select(F.col("extra_info.index").alias("index"), F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("truth"), "extra_info.split")


def u21_tagged_union(spark, sf_dir):
    o = _orders(spark, sf_dir)
    rows = tagged_union({"cnmo_en": o.filter("o_orderkey % 2 = 0"), "cnmo_zh": o.filter("o_orderkey % 2 = 1")})
    return rows.select("o_orderkey", "data_source")


def s31_system_turns(spark, sf_dir):
    c = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    m = c.select("conv_id", with_system(F.col("messages"), "Answer in one word.").alias("m"))
    return m.select("conv_id", F.size("m").alias("turns"), F.md5(F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("digest"))


def s33_generation_input(spark, sf_dir):
    """One column projected, renamed and written, as the next stage reads it."""
    path = shared_path(spark, "stage")
    _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("prompt"), "o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


def p17_generation_batch(spark, sf_dir):
    """What goes to generation and what stays for the reward, and both again by row."""
    o = with_row_id(_orders(spark, sf_dir), ["o_orderkey"])
    b = o.select(ROW, F.array("o_custkey").alias("input_ids"), F.array(F.lit(1)).alias("attention_mask"), F.array(F.lit(0)).alias("position_ids"), F.col("o_orderpriority").alias("raw_prompt"), F.col("o_orderstatus").alias("data_source"), F.col("o_orderkey").alias("uid"))
    gen, rest = generation_batch(b, ROW)
    told = f"{','.join(gen.columns)};{','.join(rest.columns)};{len(generation_batch(b, ROW, for_agents=True)[0].columns)}"
    return gen.join(rest, ROW).select(ROW, F.col("input_ids")[0].alias("id"), "raw_prompt", "data_source", "uid", F.lit(told).alias("told"))


def p34_continuation_rows(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("q", F.when(F.col("o_orderkey") % 3 == 0, F.concat("o_orderpriority", F.lit(" Think."))).otherwise(F.col("o_orderpriority")))
    rows = continuation_rows(o, "q", "o_orderstatus", "Think.", ["o_custkey"])
    return rows.select("o_orderkey", F.col("prompt")[0]["content"].alias("asked"), F.col("prompt")[1]["role"].alias("role"), "prompt_chars")


def p40_templated(spark, sf_dir):
    """Turns and plain texts, through one template."""
    c = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    a = templated(c, "messages", "text", chat_text).select("conv_id", F.md5("text").alias("digest"))
    o = templated(_orders(spark, sf_dir), "o_orderpriority", "text", chat_text).select(F.col("o_orderkey").alias("conv_id"), F.md5("text").alias("digest"))
    return a.withColumn("kind", F.lit("turns")).unionByName(o.withColumn("kind", F.lit("text")))


def p39_built(spark, sf_dir):
    o = with_row_id(_orders(spark, sf_dir), ["o_orderkey"])
    return built({"ids": o.select(ROW, F.array("o_custkey", "o_orderkey").alias("ids")), "label": o.select(ROW, F.col("o_orderstatus").alias("label"))}).select(ROW, F.element_at("ids", 2).alias("key"), "label")


def f57_stacked_pairs(spark, sf_dir):
    """Prompt and answers by the lengths of their words, ended by a token, in eight places."""
    lengths = lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]
    o = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderpriority").alias("p"), F.concat_ws(" ", F.lit("yes"), "o_custkey").alias("c"), F.repeat(F.concat("o_orderstatus", F.lit(" ")), (F.col("o_orderkey") % 9).cast("int")).alias("r"))
    s = stacked_pairs(o, "p", "c", "r", lengths, 8, end=2)
    text = lambda x: F.array_join(F.transform(x, lambda y: F.array_join(y, ",")), ";")
    return s.select("o_orderkey", text(F.col("input_ids")).alias("ids"), text(F.col("attention_mask")).alias("mask"))


def f59_template_parts(spark, sf_dir):
    """Templates with a system turn of their own: its text, and what starts the assistant's turn."""
    o = _orders(spark, sf_dir)
    parts = template_parts(lambda m, g: chat_text(m, g, default_system=F.concat(F.lit("You are "), F.col("o_orderpriority"))))
    return o.select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.system", "p.generation")


def f60_random_masks(spark, sf_dir):
    m = random_masks(_orders(spark, sf_dir), "o_orderkey", 20, most=0.7, left=0.25, least=0.2, seed=7)
    return m.select("o_orderkey", F.array_join("attention_mask", "").alias("mask"))


def j06_merged_settings(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return merged_settings(o.filter("key % 3 < 2"), o.filter("key % 3 > 0"))


def j10_mapped_back(spark, sf_dir):
    """Each line's quantity less its order's mean, by a join with the orders' means and by a window: both."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    means = li.groupBy(F.col("l_orderkey").alias("_o")).agg(F.avg("l_quantity").alias("m"))
    j = li.join(means, F.col("l_orderkey") == F.col("_o")).withColumn("w", F.avg("l_quantity").over(Window.partitionBy("l_orderkey")))
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_quantity") - F.col("m"), 5).alias("joined"), F.round(F.col("l_quantity") - F.col("w"), 5).alias("windowed"))


def f36_graded_sources(spark, sf_dir):
    """Answers of two kinds of tasks, each by its source's scorer; and a judge's boxed verdict."""
    o = _orders(spark, sf_dir)
    k = F.col("o_custkey").cast("string")
    math = F.col("o_orderkey") % 2 == 0
    t = o.withColumns({"source": F.when(math, "opencompass/cnmo2024_en").otherwise("Idavidrein/gpqa"), "text": F.when(math, F.concat(F.lit("so \\boxed{"), k, F.lit("}"))).otherwise(F.concat(F.lit("Answer: "), F.substring(F.lit("ABCD"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1)))), "truth": F.when(math, F.when(F.col("o_orderkey") % 3 == 0, k).otherwise(F.concat(k, F.lit("1")))).otherwise("B")})
    verdict = F.concat(F.lit("I say \\boxed{"), F.when(F.col("o_custkey") % 3 == 0, "True").when(F.col("o_custkey") % 3 == 1, "true").otherwise("False"), F.lit("}"))
    return t.select("o_orderkey", score_by_source(F.col("source"), F.col("text"), F.col("truth")).alias("score"), boxed_truth(F.when(F.col("o_orderkey") % 5 != 0, verdict)).alias("verdict"))


def x13_chunked_scores(spark, sf_dir):
    """A model that scores texts by their lengths, seven at a time, and the score at each answer's last token."""
    o = _orders(spark, sf_dir).withColumn("len", (F.col("o_custkey") % 5 + 1).cast("int"))
    s = chunked_scores(o, ["o_orderpriority"], lambda f: [len(x) / 4 for x in f["o_orderpriority"]], "len", 6, size=7)
    return s.select("o_orderkey", F.array_position("rm_scores", F.char_length("o_orderpriority") / 4).cast("long").alias("place"), F.aggregate("rm_scores", F.lit(0.0), lambda a, x: a + x).alias("total"))


def x10_paced(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return paced(e, ["event_id"], "user_id", requests_per_second=20.0, tokens_per_second=1000.0).select("event_id", F.round("at", 6).alias("at"))


QUERIES = {f.__name__: f for f in (s28_split_tables, p25_pair_splits, p26_model_rows, u21_tagged_union, s31_system_turns, s33_generation_input, p17_generation_batch, p34_continuation_rows, p40_templated, p39_built, f57_stacked_pairs, f59_template_parts, f60_random_masks, j06_merged_settings, j10_mapped_back, f36_graded_sources, x13_chunked_scores, x10_paced)}
_I = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"
_CHAT = "'<|im_start|>' || {} || chr(10) || {} || '<|im_end|>' || chr(10)"
ORACLES = {
    "s28_split_tables": f"SELECT CASE WHEN i < floor(n * 0.9 + 1e-9) THEN 'train' ELSE 'test' END AS split, i AS index, 'math-dapo' AS data_source, 'Math' AS ability, md5(trim(o_orderpriority) || chr(10) || chr(10) || 'Please reason step by step, and put your final answer within \\boxed{{}}.') AS prompt, o_custkey::VARCHAR AS truth FROM {_I}",
    "p25_pair_splits": f"SELECT CASE WHEN i < floor(n * 0.75 + 1e-9) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last, count(DISTINCT o_custkey) AS chosen FROM {_I} GROUP BY 1",
    "p26_model_rows": f"SELECT i AS index, o_orderpriority AS content, 'model' AS style, o_orderstatus AS truth, 'train' AS split FROM {_I}",
    "u21_tagged_union": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'cnmo_en' ELSE 'cnmo_zh' END AS data_source FROM orders",
    "s31_system_turns": "SELECT conv_id, (1 + count(*) FILTER (role <> 'system'))::INT AS turns, md5('system:Answer in one word.' || coalesce(string_agg('|' || concat_ws(':', role, text), '' ORDER BY turn) FILTER (role <> 'system'), '')) AS digest FROM conversations GROUP BY 1",
    "s33_generation_input": "SELECT o_orderpriority AS prompt, o_orderkey FROM orders",
    "p17_generation_batch": f"SELECT i AS row_id, o_custkey AS id, o_orderpriority AS raw_prompt, o_orderstatus AS data_source, o_orderkey AS uid, 'row_id,input_ids,attention_mask,position_ids,raw_prompt;row_id,data_source,uid;7' AS told FROM {_I}",
    "p34_continuation_rows": "SELECT o_orderkey, o_orderpriority || ' Think.' AS asked, 'assistant' AS role, (length(o_orderpriority) + 7 + length(o_orderstatus))::INT AS prompt_chars FROM orders",
    "p40_templated": f"SELECT conv_id, md5(string_agg({_CHAT.format('role', 'text')}, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS digest, 'turns' AS kind FROM conversations GROUP BY 1 UNION ALL SELECT o_orderkey, md5({_CHAT.format(chr(39) + 'user' + chr(39), 'o_orderpriority')} || '<|im_start|>assistant' || chr(10)), 'text' FROM orders",
    "p39_built": f"SELECT i AS row_id, o_orderkey AS key, o_orderstatus AS label FROM {_I}",
    "f57_stacked_pairs": """WITH t AS (SELECT o_orderkey, list_transform(list_filter(string_split(o_orderpriority, ' '), lambda w: w <> ''), lambda w: length(w)) AS p, [3, length(o_custkey::VARCHAR)] AS c, list_transform(range(o_orderkey % 9), lambda i: 1) AS r FROM orders),
        s AS (SELECT o_orderkey, list_concat(p, c, [2])[:8] AS a, list_concat(p, r, [2])[:8] AS b FROM t)
        SELECT o_orderkey, array_to_string(list_concat(a, list_transform(range(8 - len(a)), lambda i: 0)), ',') || ';' || array_to_string(list_concat(b, list_transform(range(8 - len(b)), lambda i: 0)), ',') AS ids,
          array_to_string(list_transform(range(8), lambda i: (i < len(a))::INT), ',') || ';' || array_to_string(list_transform(range(8), lambda i: (i < len(b))::INT), ',') AS mask FROM s""",
    "f59_template_parts": f"SELECT o_orderkey, {_CHAT.format(chr(39) + 'system' + chr(39), chr(39) + 'You are ' + chr(39) + ' || o_orderpriority')} AS system, '<|im_start|>assistant' || chr(10) AS generation FROM orders",
    "f60_random_masks": "WITH u AS (SELECT o_orderkey, floor(('0x' || md5('7/pad/' || o_orderkey)[:8])::BIGINT / 4294967296.0 * 6)::INT AS pad, 4 + floor(('0x' || md5('7/valid/' || o_orderkey)[:8])::BIGINT / 4294967296.0 * 11)::INT AS n FROM orders) SELECT o_orderkey, repeat('0', pad) || repeat('1', n) || repeat('0', 20 - pad - n) AS mask FROM u",
    "j06_merged_settings": "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders",
    "j10_mapped_back": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER w, 5)::DOUBLE AS joined, round(l_quantity - avg(l_quantity) OVER w, 5)::DOUBLE AS windowed FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
    "f36_graded_sources": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 ELSE o_custkey % 4 = 1 END::INT::DOUBLE AS score, (o_custkey % 3 = 0 AND o_orderkey % 5 <> 0)::INT::DOUBLE AS verdict FROM orders",
    "x13_chunked_scores": "SELECT o_orderkey, o_custkey % 5 + 1 AS place, length(o_orderpriority) / 4.0::DOUBLE AS total FROM orders",
    "x10_paced": "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM events) SELECT event_id, round(greatest(i / 20.0, t / 1000.0), 6)::DOUBLE AS at FROM e",
}

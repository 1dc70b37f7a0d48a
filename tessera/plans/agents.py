"""Agents and their surroundings: registries of parsers, tools with a life of their own, generators, prefetching, time limits.

Tools and generators are Python table functions over a table that is partitioned by trajectory (or key) and ordered: one
instance a partition sees its rows one after the other, so nothing of a long trajectory is held but the tool's own state.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import answers
from ..functions.rewards import scattered
from . import curation

PARSERS: dict[str, Callable[[Column], Column]] = {}
TOOLS: dict[str, type[Tool]] = {}
DATASETS: dict[str, Callable[..., DataFrame]] = {}


def register(registry: dict, name: str):
    """Put a function or class under a name; another one under the same name raises."""

    def add(f):
        if registry.get(name, f) is not f:
            raise ValueError(f"{name!r} is taken")
        registry[name] = f
        return f

    return add


def find(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"no {name!r}; there are {sorted(registry)}")
    return registry[name]


register(PARSERS, "hermes")(lambda text: F.transform(answers.tool_calls(text), lambda c: F.struct(c["name"].alias("name"), F.to_json(c["arguments"]).alias("arguments"))))
register(PARSERS, "channels")(lambda text: answers.channel_calls(text))


def parsed_calls(text: Column, parser: str) -> Column:
    """Array of (name, arguments as JSON) by the parser of that name."""
    return find(PARSERS, parser)(text)


# --- tools ---
class Tool:
    """create, execute, reward, release: what a trajectory does with a tool."""

    def create(self, trajectory) -> None: ...

    def execute(self, arguments: dict) -> tuple[str, float]:
        raise NotImplementedError

    def reward(self) -> float:
        return 0.0

    def release(self) -> None: ...


@register(TOOLS, "answer_check")
class AnswerCheck(Tool):
    """Scores the last answer that was given; an answer no better than the one before costs 0.05."""

    def create(self, trajectory) -> None:
        self.best = 0.0

    def execute(self, arguments: dict) -> tuple[str, float]:
        score = float(arguments.get("answer") == arguments.get("truth"))
        step = 0.0 if score > self.best else -0.05
        self.best = max(self.best, score)
        return f"score {score}", step

    def reward(self) -> float:
        return self.best


def _table_argument(argument: AnalyzeArgument, columns: set[str]) -> None:
    if not argument.isTable:
        raise ValueError("the function takes a table")
    if missing := columns - set(argument.dataType.names):
        raise ValueError(f"the table has no {sorted(missing)}")


def run_tools(calls: DataFrame, trajectory: str, order: str, name: str, arguments: str) -> DataFrame:
    """trajectory, ord, response, step_reward, tool_reward of the calls (JSON arguments) of each trajectory, in order.

    Every tool has one instance a trajectory; an unknown tool or broken arguments give an error as response and 0.
    """
    use = calls.select(F.col(trajectory).cast("long").alias("trajectory"), F.col(order).cast("long").alias("ord"), F.col(name).alias("name"), F.col(arguments).alias("arguments"))
    tools, out = dict(TOOLS), StructType.fromDDL("trajectory long, ord long, response string, step_reward double, tool_reward double")

    @F.udtf
    class ToolCalls:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            _table_argument(table, {"trajectory", "ord", "name", "arguments"})
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("trajectory")], orderBy=[OrderingColumn("ord")])

        def __init__(self):
            self.held: dict[str, Tool] = {}

        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                if row["name"] not in self.held:
                    tool = tools[row["name"]]()
                    tool.create(row["trajectory"])
                    self.held[row["name"]] = tool
                response, step = self.held[row["name"]].execute(json.loads(row["arguments"]))
                yield row["trajectory"], row["ord"], response, float(step), float(self.held[row["name"]].reward())
            except (KeyError, ValueError, TypeError) as error:
                yield row["trajectory"], row["ord"], f"error: {type(error).__name__}", 0.0, 0.0

        def terminate(self) -> None:
            for tool in self.held.values():
                tool.release()

    return ToolCalls(use.asTable())


# --- rows of loops ---
def postprocessed(parts: list[DataFrame], length: str, width: int, score: str = "score") -> DataFrame:
    """Rows of several loops as one table, missing columns null, with the score at the last token where there is one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("rm_scores", F.when(F.col(score).isNotNull(), scattered(F.col(score), F.col(length), F.lit(width))))


def judge_prompt(prompt: Column, response: Column, question: str = "Is this right? Answer yes or no.") -> Column:
    return F.concat(F.lit("## Prompt\n"), prompt, F.lit("\n## Response\n"), response, F.lit(f"\n{question}"))


def rollout_log(df: DataFrame, columns: list[str], request: str = "request_id") -> DataFrame:
    """The logged columns, and the request's id where the rows have one."""
    return df.select(*columns, *([request] if request in df.columns else []))


def stage_prompts(df: DataFrame, messages: str, truth: str, instruction: str) -> DataFrame:
    """q_id-less rows of a first stage: the first user's message with the instruction, as one turn, and the truth as text."""
    first = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"]
    content = curation.with_instruction(F.col("_q"), instruction)
    rows = df.withColumn("_q", first).filter("_q is not null")
    return rows.withColumns({"prompt": F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))), "ground_truth": F.col(truth).cast("string")}).drop("_q")


# --- generators and limits ---
class Generator:
    """A user's generator of new rows from old ones: start of a key, each of its rows in order, and the end."""

    def start(self, key) -> None: ...

    def row(self, row: dict) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def generated_table(df: DataFrame, generator: Callable[[], Generator], schema: str, key: str, order: str) -> DataFrame:
    """What a generator gives for the rows of each key, in ``order``; an instance a key, which sees one row at a time.

    A null key is a key; an empty table gives no rows.
    """
    kind = StructType.fromDDL(schema)

    @F.udtf
    class Generated:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            _table_argument(table, {key, order})
            return AnalyzeResult(schema=kind, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def __init__(self):
            self.made: Generator | None = None

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.made is None:
                self.made = generator()
                self.made.start(row[key])
            yield from self.made.row(row.asDict())

        def terminate(self) -> Iterator[tuple]:
            if self.made is not None:
                yield from self.made.end()

    return Generated(df.asTable())


def appended(df: DataFrame, more: DataFrame, order: list[str]) -> DataFrame:
    """A dataset with what a generator has made behind it: rows numbered through, old ones first; lacking columns are null."""
    from ..operators.frame import with_row_id

    both = df.withColumn("_new", F.lit(0)).unionByName(more.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return with_row_id(both, ["_new", *order]).drop("_new")


def one_ahead(makers: Iterable[Callable[[], DataFrame]]) -> Iterator[DataFrame]:
    """The results of the makers in order; while the caller has one, the next is being made."""
    with ThreadPoolExecutor(1) as pool:
        waiting = None
        for make in makers:
            job = pool.submit(make)
            if waiting is not None:
                yield waiting.result()
            waiting = job
        if waiting is not None:
            yield waiting.result()


def within(seconds: float, f: Callable, *args):
    """f's result, or TimeoutError after that time; the call itself can't be stopped and goes on behind."""
    box: list = []

    def call() -> None:
        try:
            box.append((True, f(*args)))
        except BaseException as error:  # noqa: BLE001  handed to the caller
            box.append((False, error))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no result within {seconds} seconds")
    ok, value = box[0]
    if not ok:
        raise value
    return value


@register(DATASETS, "prompts")
def prompts_dataset(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    from ..sources.tables import read_prompts

    return read_prompts(spark, paths, options.pop("keys"), **options)


@register(DATASETS, "pairs")
def pairs_dataset(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    from ..sources.tables import read_pairs

    return read_pairs(spark, paths, **options)


# --- queries ---
def x27_parsed(spark, sf_dir):
    """The same calls in two markups, by the parsers of their names."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")
    body = F.concat(F.lit('{"u": "'), F.col("user_id").cast("string"), F.lit('"}'))
    a = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), body, F.lit("}</tool_call>"), F.when(F.col("event_id") % 3 == 0, "<tool_call>{oops</tool_call>").otherwise(F.lit('<tool_call>{"name": "n", "arguments": {}}</tool_call>')))
    b = F.concat(F.lit("<|start|>assistant<|channel|>commentary to=functions."), "event_type", F.lit(" <|constrain|>json<|message|>"), body, F.lit("<|call|>"))
    t = e.select("event_id", parsed_calls(a, "hermes").alias("h"), parsed_calls(b, "channels").alias("c"))
    return t.select("event_id", F.size("h").alias("hermes"), F.size("c").alias("channels"), F.col("h")[0]["name"].alias("first"), F.get_json_object(F.col("h")[0]["arguments"], "$.u").alias("hu"), F.get_json_object(F.col("c")[0]["arguments"], "$.u").alias("cu"))


def x24_tools(spark, sf_dir):
    """Answers of users, as trajectories, through a tool that remembers; some calls name no tool or are broken."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    right = F.when(F.col("event_id") % 4 == 0, "t").otherwise("f")
    name = F.when(F.col("event_id") % 11 == 0, "unknown").otherwise("answer_check")
    args = F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(F.concat(F.lit('{"answer": "'), right, F.lit('", "truth": "t"}')))
    done = run_tools(e.withColumns({"name": name, "args": args}), "user_id", "event_id", "name", "args")
    return done.select(F.col("ord").alias("event_id"), "response", "step_reward", "tool_reward")


def x40_postprocessed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("len"))
    a = o.filter("o_orderkey % 2 = 0").withColumns({"score": F.lit(2.0), "turns": F.lit(3)})
    b = o.filter("o_orderkey % 2 = 1").withColumn("score", F.lit(None).cast("double"))
    return postprocessed([a, b], "len", 4).select("o_orderkey", "turns", F.aggregate("rm_scores", F.lit(0.0), lambda s, x: s + x).alias("total"))


def x43_judge_prompts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = rollout_log(o.withColumn("request_id", F.col("o_orderkey").cast("string")), ["o_orderkey", "o_orderpriority"])
    return rows.select("o_orderkey", "request_id", F.md5(judge_prompt(F.col("o_orderpriority"), F.col("request_id"))).alias("digest"))


def p32_stage_prompts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    m = curation.conversations(c, "conv_id", "turn", "role", "text")
    rows = stage_prompts(m.withColumn("truth", F.col("conv_id") * 2), "messages", "truth", "Think.")
    return rows.select("conv_id", F.md5(F.col("prompt")[0]["content"]).alias("digest"), F.col("prompt")[0]["role"].alias("role"), "ground_truth")


class Harder(Generator):
    """For each user a follow-up of every third event, and one row at the end that sums them up."""

    def start(self, key) -> None:
        self.key, self.n, self.last = key, 0, 0

    def row(self, row: dict) -> Iterator[tuple]:
        self.n, self.last = self.n + 1, row["event_id"]
        if self.n % 3 == 0:
            yield self.key, row["event_id"], f"again {row['event_type']}"

    def end(self) -> Iterator[tuple]:
        yield self.key, self.last, f"{self.n} events"


def x29_generated(spark, sf_dir):
    """Events, and behind them what a generator has made of every user's, numbered through."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    more = generated_table(e, Harder, "user_id long, event_id long, event_type string", "user_id", "event_id")
    return appended(e, more, ["event_id", "event_type"])


def m11_one_ahead(spark, sf_dir):
    """Batches that are made while the one before is summed, in order."""
    from ..session import written

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    last = e.agg(F.max("event_id")).first()[0]
    size = last // 4 + 1
    makers = [lambda i=i: written(e.filter(F.expr(f"event_id div {size} = {i}")), "ahead") for i in range(4)]
    rows = [(i, *b.agg(F.count("*"), F.sum("user_id")).first()) for i, b in enumerate(one_ahead(makers))]
    return spark.createDataFrame(rows, "batch long, n long, users long")


def x28_datasets(spark, sf_dir):
    """Two kinds of datasets by their names."""
    a = find(DATASETS, "prompts")(spark, [f"{sf_dir}/documents.parquet"], keys=["doc_id"])
    b = find(DATASETS, "pairs")(spark, [f"{sf_dir}/nation.parquet"], prompt="n_nationkey", chosen="n_name", rejected="n_regionkey")
    return a.agg(F.lit("prompts").alias("kind"), F.count("*").alias("n")).unionByName(b.agg(F.lit("pairs").alias("kind"), F.count("chosen").alias("n")))


QUERIES = {f.__name__: f for f in (x27_parsed, x24_tools, x40_postprocessed, x43_judge_prompts, p32_stage_prompts, x29_generated, m11_one_ahead, x28_datasets)}
ORACLES = {
    "x27_parsed": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::INT AS hermes, 1::INT AS channels, event_type AS first, user_id::VARCHAR AS hu, user_id::VARCHAR AS cu FROM events",
    "x24_tools": "WITH c AS (SELECT user_id, event_id, event_id % 11 = 0 AS unknown, event_id % 13 = 0 AS broken, (event_id % 4 = 0)::INT::DOUBLE AS s FROM events), b AS (SELECT *, coalesce(max(CASE WHEN unknown OR broken THEN 0 ELSE s END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT event_id, CASE WHEN unknown THEN 'error: KeyError' WHEN broken THEN 'error: JSONDecodeError' WHEN s = 1 THEN 'score 1.0' ELSE 'score 0.0' END AS response, CASE WHEN unknown OR broken OR s > before THEN 0.0 ELSE -0.05 END::DOUBLE AS step_reward, CASE WHEN unknown OR broken THEN 0.0 ELSE greatest(s, before) END::DOUBLE AS tool_reward FROM b",
    "x40_postprocessed": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 3 END::INT AS turns, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 5 > 0 THEN 2.0 ELSE 0.0 END END::DOUBLE AS total FROM orders",
    "x43_judge_prompts": "SELECT o_orderkey, o_orderkey::VARCHAR AS request_id, md5('## Prompt' || chr(10) || o_orderpriority || chr(10) || '## Response' || chr(10) || o_orderkey || chr(10) || 'Is this right? Answer yes or no.') AS digest FROM orders",
    "p32_stage_prompts": "SELECT conv_id, md5(CASE WHEN contains(arg_min(text, turn), 'Think.') THEN arg_min(text, turn) ELSE arg_min(text, turn) || ' Think.' END) AS digest, 'user' AS role, (conv_id * 2)::VARCHAR AS ground_truth FROM conversations WHERE role = 'user' GROUP BY 1, 4",
    "x29_generated": "WITH i AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), m AS (SELECT user_id, event_id, 'again ' || event_type AS event_type, 1 AS new FROM i WHERE i % 3 = 0 UNION ALL SELECT user_id, max(event_id), count(*) || ' events', 1 FROM i GROUP BY 1 UNION ALL SELECT user_id, event_id, event_type, 0 FROM events) SELECT user_id, event_id, event_type, row_number() OVER (ORDER BY new, event_id, event_type) - 1 AS row_id FROM m",
    "m11_one_ahead": "SELECT event_id // (m // 4 + 1) AS batch, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events, (SELECT max(event_id) AS m FROM events) GROUP BY 1",
    "x28_datasets": "SELECT 'prompts' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'pairs', count(n_name) FROM nation",
}

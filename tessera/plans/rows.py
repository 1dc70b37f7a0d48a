"""Dataset rows for training: tokenized prompts and chats, collation, filters by tokens, quotas, continuations, payloads.

A tokenizer is a user's function from texts to lists of ids.  It runs in Arrow batches over distinct columns; whatever
follows - cutting, padding, masks, positions - is column expressions over the ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.arrays import fixed_width, padded, truncated
from ..operators.frame import ROW, SampleFrame, with_row_id
from ..operators.tokens import position_ids
from .curation import renamed_legacy

Encode = Callable[[list[str]], list[list[int]]]


def encoded(df: DataFrame, text: str | Sequence[str], encode: Encode, out: str | Sequence[str] = "ids", each: bool = False) -> DataFrame:
    """``df`` with the ids of a text, or with ``each`` those of every text of an array; null is empty.

    Several columns of texts, with as many names, are encoded in one pass, so by one Python worker a task.
    """
    names, texts, outs = df.columns, [text] if isinstance(text, str) else list(text), [out] if isinstance(out, str) else list(out)
    kind = pa.list_(pa.list_(pa.int64())) if each else pa.list_(pa.int64())

    def ids(values: list) -> pa.Array:
        if not each:
            return pa.array(encode([v or "" for v in values]), kind)
        flat = [x or "" for v in values for x in v or ()]
        ids, at, found = encode(flat), 0, []
        for v in values:
            n = len(v or ())
            found.append(ids[at : at + n])
            at += n
        return pa.array(found, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [ids(b.column(names.index(t)).to_pylist()) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*names, *outs])

    inner = T.ArrayType(T.LongType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(o, T.ArrayType(inner) if each else inner) for o in outs]]))


# --- prompts ---
def prompt_tensors(df: DataFrame, prompt: str, encode: Encode, width: int, pad: int = 0, *, how: str = "error") -> DataFrame:
    """``df`` with input_ids (cut by ``how`` and padded on the left to ``width``), attention_mask, position_ids and raw_prompt_ids."""
    rows = encoded(df, prompt, encode, "_ids").withColumn("raw_prompt_ids", truncated(F.col("_ids"), width, how))
    n = F.size("raw_prompt_ids")
    mask = F.concat(F.array_repeat(F.lit(0), F.lit(width) - n), F.array_repeat(F.lit(1), n))
    rows = rows.withColumns({"input_ids": padded(F.col("raw_prompt_ids"), width, F.lit(pad).cast("long"), left=True), "attention_mask": mask})
    return rows.withColumn("position_ids", position_ids("attention_mask")).drop("_ids")


def within_tokens(df: DataFrame, prompt: str, encode: Encode, most: int) -> DataFrame:
    """Rows whose prompt has at most ``most`` tokens."""
    return encoded(df, prompt, encode, "_ids").filter(F.size("_ids") <= most).drop("_ids")


def chat_tensors(df: DataFrame, messages: str, encode: Encode, headers: dict[str, Sequence[int]], width: int | None = None, pad: int = 0, *, how: str = "error") -> DataFrame:
    """``df`` with input_ids, attention_mask, loss_mask and position_ids of chats.

    A message is its role's header and its content; the loss is on the contents of assistants.  With ``width`` rows are
    cut by ``how`` and padded on the right; without it they keep their lengths.
    """
    of_role = F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), F.array(*[F.lit(i).cast("long") for i in v]).cast("array<bigint>"))])
    rows = encoded(df.withColumn("_texts", F.transform(messages, lambda m: m["content"])), "_texts", encode, "_each", each=True)
    parts = F.transform(F.arrays_zip(F.col(messages).alias("m"), F.col("_each").alias("ids")), lambda t: F.struct(F.try_element_at(of_role, t["m"]["role"]).alias("head"), t["ids"].alias("ids"), (t["m"]["role"] == "assistant").cast("int").alias("on")))
    rows = rows.withColumn("_parts", parts)
    ids = F.flatten(F.transform("_parts", lambda p: F.concat(p["head"], p["ids"])))
    loss = F.flatten(F.transform("_parts", lambda p: F.concat(F.transform(p["head"], lambda _: F.lit(0).cast("long")), F.transform(p["ids"], lambda _: p["on"].cast("long")))))
    rows = rows.withColumns({"input_ids": ids, "loss_mask": loss}).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("long")))
    if width:
        rows = rows.withColumns({c: fixed_width(F.col(c), width, v, left=False, how=how) for c, v in (("input_ids", pad), ("loss_mask", 0), ("attention_mask", 0))})
    return rows.withColumn("position_ids", position_ids("attention_mask")).drop("_texts", "_each", "_parts")


def collated(df: DataFrame, batch: str, row: str, columns: Sequence[str], pad: int = 0, *, jagged: bool = False) -> DataFrame:
    """A row a batch: token columns padded to the batch's longest, or with ``jagged`` as values and offsets; others as lists."""
    g = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("_o"), *[c for c in df.columns if c != batch]))).alias("_l"))
    out = [F.col(batch)]
    for c in df.columns:
        if c == batch:
            continue
        items = F.col(f"_l.{c}")
        if c not in columns:
            out.append(items.alias(c))
        elif jagged:
            ends = F.aggregate(F.transform(items, lambda x: F.size(x)), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
            out += [F.flatten(items).alias(f"{c}_values"), ends.alias(f"{c}_offsets")]
        else:
            width = F.array_max(F.transform(items, lambda x: F.size(x)))
            out.append(F.transform(items, _padder(width, pad)).alias(c))
    return g.select(*out)


def _padder(width: Column, pad: int):
    return lambda x: F.concat(x, F.array_repeat(F.lit(pad).cast("long"), width - F.size(x)))


# --- quotas and continuations ---
def until_quota(batches: Iterator[DataFrame], keep: Callable[[DataFrame], DataFrame], key: str, order: Sequence[str], quota: int, most: int) -> DataFrame:
    """Kept rows of one batch after the other until ``quota`` keys are there; then the rows of the first ``quota`` keys.

    More than ``most`` batches raise.  The driver holds counts alone.
    """
    out = None
    for i, batch in enumerate(batches):
        if i >= most:
            raise ValueError(f"fewer than {quota} in {most} batches")
        part = keep(batch)
        out = part if out is None else out.unionByName(part)
        if out.select(key).distinct().count() >= quota:
            break
    if out is None:
        raise ValueError("no batch")
    first = out.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first").limit(quota).select(F.col(key).alias("_key"))
    return out.join(first, F.col(key) == F.col("_key"), "left_semi")


def is_chat_prompt(df: DataFrame, column: str) -> bool:
    """Whether the column is there and its first row is a list of turns with role and content."""
    if column not in df.columns:
        return False
    kind = df.schema[column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {"role", "content"} <= set(kind.elementType.names)):
        return False
    first = df.select(column).first()
    return first is not None and bool(first[0])


def continued(prompts: SampleFrame, outputs: SampleFrame, *, text: str, responses: str, token: str, score: Callable[[Column], Column]) -> DataFrame:
    """Continuations by position: a row each, its whole text, its score, and the mean score of its token."""
    both = prompts.union_columns(outputs).df
    each = both.select(ROW, text, token, F.posexplode(responses).alias("sample_id", "continuation"))
    each = each.withColumn("full_text", F.concat(text, "continuation")).withColumn("score", score(F.col("full_text")))
    mean = each.groupBy(token).agg(F.avg("score").alias("token_accuracy"))
    return each.join(mean, token)


def answered(questions: SampleFrame, outputs: SampleFrame, responses: str, out: str = "token_id") -> DataFrame:
    """Questions with their outputs by position, a row a response: sample_id, response and a dense ``out`` over all of them."""
    both = questions.union_columns(outputs).df
    rest = [c for c in both.columns if c != responses]
    return with_row_id(both.select(*rest, F.posexplode(responses).alias("sample_id", "response")), [ROW, "sample_id"], out)


def repeats_summed(df: DataFrame, position: str, value: str, rows: int) -> DataFrame:
    """row, total: sums over the repeats of a list that holds all rows, and then all rows again."""
    return df.groupBy((F.col(position) % rows).alias("row")).agg(F.sum(value).alias("total"))


def generation_rows(f: SampleFrame, drop: Sequence[str], agent: str, n: int) -> SampleFrame:
    """Without the prompt's tensors, with the agent's name, every row ``n`` times."""
    return f.select([c for c in f.columns if c not in drop]).assign(agent_name=F.lit(agent)).repeat(n)


def inflated(df: DataFrame, column: str, out: str) -> DataFrame:
    """Texts from base64 of zlib; a payload that is neither stays null."""
    names = df.columns

    def one(x: str | None) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(x, validate=True)).decode() if x is not None else None
        except (ValueError, zlib.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x) for x in b.column(names.index(column)).to_pylist()], pa.string())], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def last_assistant_score(messages: Column, truth: Column) -> Column:
    """1 if the last turn of an assistant is the truth, else 0; a chat without one has 0."""
    last = F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))
    return F.coalesce((F.trim(last["content"]) == truth).cast("double"), F.lit(0.0))


def used_tool(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "tool").cast("double")


# --- queries: words' lengths are the ids ---
def _lengths(texts: list[str]) -> list[list[int]]:
    return [[len(w) for w in t.split(" ") if w] for t in texts]


def _chats(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+", " "))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("l"))
    return g.select("conv_id", F.transform("l", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def _plain(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+", " ").alias("text"))


_joined = lambda c: F.array_join(c, ",")


def f58_prompt_tensors(spark, sf_dir):
    """Prompts of twelve tokens, cut in the middle."""
    rows = prompt_tensors(_plain(spark, sf_dir), "text", _lengths, 12, how="middle")
    return rows.select("doc_id", *[_joined(c).alias(c) for c in ("input_ids", "attention_mask", "position_ids", "raw_prompt_ids")])


def f55_chat_tensors(spark, sf_dir):
    """Chats of forty tokens, cut on the right and padded; the loss is on assistants."""
    rows = chat_tensors(_chats(spark, sf_dir), "messages", _lengths, {"user": [101, 1], "assistant": [102, 1], "system": [103]}, 40, how="right")
    return rows.select("conv_id", *[_joined(c).alias(c) for c in ("input_ids", "loss_mask", "attention_mask")])


def r06_within_tokens(spark, sf_dir):
    return within_tokens(_plain(spark, sf_dir), "text", _lengths, 300).select("doc_id")


def u10_collated(spark, sf_dir):
    """Batches of sixteen documents, padded to the longest of each."""
    rows = encoded(_plain(spark, sf_dir), "text", _lengths).select(F.expr("doc_id div 16").alias("batch"), "doc_id", "ids")
    c = collated(rows, "batch", "doc_id", ["ids"])
    return c.select("batch", _joined("doc_id").alias("docs"), F.md5(F.array_join(F.transform("ids", lambda x: F.array_join(x, ",")), ";")).alias("digest"), F.size(F.col("ids")[0]).alias("width"))


def u09_jagged(spark, sf_dir):
    rows = encoded(_plain(spark, sf_dir), "text", _lengths).select(F.expr("doc_id div 16").alias("batch"), "doc_id", "ids")
    c = collated(rows, "batch", "doc_id", ["ids"], jagged=True)
    return c.select("batch", F.md5(_joined("ids_values")).alias("digest"), _joined("ids_offsets").alias("offsets"))


def r08_quota(spark, sf_dir):
    """Users whose events of a batch (a twentieth of all) differ enough, until 60 of them are there."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    size = e.agg(F.max("event_id")).first()[0] // 20 + 1
    batches = (e.filter(F.expr(f"event_id div {size} = {i}")) for i in range(20))

    def keep(batch: DataFrame) -> DataFrame:
        wide = batch.groupBy(F.col("user_id").alias("_u")).agg((F.max("value") - F.min("value")).alias("_w")).filter("_w > 100")
        return batch.join(wide, F.col("user_id") == F.col("_u"), "left_semi")

    return until_quota(batches, keep, "user_id", ["event_id"], 60, 20).select("event_id", "user_id")


def r17_renamed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prompt"))
    return renamed_legacy(o, ["id", "question"], {"prompt": "question", "text": "id"})


def r18_chat_prompts(spark, sf_dir):
    chats = _chats(spark, sf_dir)
    checks = [("chats", is_chat_prompt(chats, "messages")), ("missing", is_chat_prompt(chats, "question")), ("numbers", is_chat_prompt(chats, "conv_id")), ("empty", is_chat_prompt(chats.limit(0), "messages"))]
    return spark.createDataFrame(checks, "check string, ok boolean")


def j09_continued(spark, sf_dir):
    """Three continuations of each order, right where the text ends in the key's last digit; mean by priority as token."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_custkey")
    rows = with_row_id(o, ["o_orderkey"])
    prompts = SampleFrame(rows.select(ROW, F.concat(F.col("o_orderkey").cast("string"), F.lit(":")).alias("text"), F.col("o_orderpriority").alias("token")))
    outputs = SampleFrame(rows.select(ROW, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("o_custkey") + i) % 10).cast("string")).alias("responses")))
    done = continued(prompts, outputs, text="text", responses="responses", token="token", score=lambda t: (F.substring(t, -1, 1) == F.substring(F.substring_index(t, ":", 1), -1, 1)).cast("double"))
    return done.select(ROW, F.col("sample_id").cast("long").alias("sample_id"), "full_text", "score", F.round("token_accuracy", 8).alias("token_accuracy"))


def j08_answered(spark, sf_dir):
    """Orders as questions and the lines' parts as their responses, from one to seven each."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("responses"))
    rows = with_row_id(li, ["l_orderkey"])
    done = answered(SampleFrame(rows.select(ROW, "l_orderkey")), SampleFrame(rows.select(ROW, "responses")), "responses")
    return done.select("token_id", ROW, "l_orderkey", F.col("sample_id").cast("long").alias("sample_id"), "response")


def j12_repeats(spark, sf_dir):
    o = with_row_id(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return repeats_summed(o, ROW, "o_custkey", 100)


def p31_payloads(spark, sf_dir):
    """Payloads of JSON in zlib and base64, of days in a range; every tenth is broken."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "props", "user_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [base64.b64encode(zlib.compress(p.encode())).decode() if i % 10 else "@broken" for i, p in zip(b.column("event_id").to_pylist(), b.column("props").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("day"), pa.array(made)], ["event_id", "day", "payload"])

    packed = e.mapInArrow(pack, "event_id long, day string, payload string")
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    kept = inflated(packed.filter((F.col("day") > lo) & (F.col("day") <= hi)), "payload", "text")
    return kept.select("event_id", F.get_json_object("text", "$.k").alias("k"))


def p35_formatted(spark, sf_dir):
    """Template rows as one JSON array for each 64 keys."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 64").alias("batch"), "o_orderkey")
    line = F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("prompt"))
    g = o.groupBy("batch").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"])).alias("rows"))
    return g.select("batch", F.md5("rows").alias("digest"))


def p44_generation_rows(spark, sf_dir):
    f = SampleFrame.of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return generation_rows(f, ["o_custkey"], "single_turn", 3).df


def m16_interactions(spark, sf_dir):
    """The last assistant's turn against its own text and against another; whether a tool spoke."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.trim(F.max_by("text", "turn")).alias("said"))
    m = _raw_chats(spark, sf_dir).join(last, "conv_id", "left")
    return m.select("conv_id", last_assistant_score(F.col("messages"), F.when(F.col("conv_id") % 2 == 0, F.col("said")).otherwise("other")).alias("score"), used_tool(F.col("messages")).alias("tool"))


def _raw_chats(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("l"))
    return g.select("conv_id", F.transform("l", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


QUERIES = {f.__name__: f for f in (f58_prompt_tensors, f55_chat_tensors, r06_within_tokens, u10_collated, u09_jagged, r08_quota, r17_renamed, r18_chat_prompts, j08_answered, j09_continued, j12_repeats, p31_payloads, p35_formatted, p44_generation_rows, m16_interactions)}
_CLEAN = r"regexp_replace(coalesce(text, ''), '[^\x21-\x7e]+', ' ', 'g')"
_IDS = f"list_transform(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> ''), lambda w: length(w))"
ORACLES = {
    "f58_prompt_tensors": f"WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents), r AS (SELECT doc_id, CASE WHEN len(ids) > 12 THEN list_concat(ids[:6], ids[-6:]) ELSE ids END AS ids FROM t) SELECT doc_id, array_to_string(list_concat(list_transform(range(12 - len(ids)), lambda i: 0), ids), ',') AS input_ids, array_to_string(list_transform(range(12), lambda i: (i >= 12 - len(ids))::INT), ',') AS attention_mask, array_to_string(list_transform(range(12), lambda i: greatest(i - (12 - len(ids)), 0)), ',') AS position_ids, array_to_string(ids, ',') AS raw_prompt_ids FROM r",
    "f55_chat_tensors": f"WITH t AS (SELECT conv_id, turn, role, {_IDS} AS ids, CASE role WHEN 'user' THEN [101, 1] WHEN 'assistant' THEN [102, 1] ELSE [103] END AS head FROM conversations), p AS (SELECT conv_id, flatten(list(list_concat(head, ids) ORDER BY turn)) AS ids, flatten(list(list_concat(list_transform(head, lambda x: 0), list_transform(ids, lambda x: (role = 'assistant')::INT)) ORDER BY turn)) AS loss FROM t GROUP BY 1), c AS (SELECT conv_id, ids[:40] AS ids, loss[:40] AS loss FROM p) SELECT conv_id, array_to_string(list_concat(ids, list_transform(range(40 - len(ids)), lambda i: 0)), ',') AS input_ids, array_to_string(list_concat(loss, list_transform(range(40 - len(ids)), lambda i: 0)), ',') AS loss_mask, array_to_string(list_transform(range(40), lambda i: (i < len(ids))::INT), ',') AS attention_mask FROM c",
    "r06_within_tokens": f"SELECT doc_id FROM documents WHERE len({_IDS}) <= 300",
    "u10_collated": f"WITH t AS (SELECT doc_id // 16 AS batch, doc_id, {_IDS} AS ids FROM documents), w AS (SELECT batch, max(len(ids)) AS w FROM t GROUP BY 1) SELECT batch, string_agg(doc_id, ',' ORDER BY doc_id) AS docs, md5(string_agg(array_to_string(list_concat(ids, list_transform(range(w - len(ids)), lambda i: 0)), ','), ';' ORDER BY doc_id)) AS digest, any_value(w)::INT AS width FROM t JOIN w USING (batch) GROUP BY 1",
    "u09_jagged": f"WITH t AS (SELECT doc_id // 16 AS batch, doc_id, {_IDS} AS ids FROM documents), e AS (SELECT *, sum(len(ids)) OVER (PARTITION BY batch ORDER BY doc_id) AS e FROM t) SELECT batch, md5(array_to_string(flatten(list(ids ORDER BY doc_id)), ',')) AS digest, '0,' || string_agg(e::BIGINT, ',' ORDER BY doc_id) AS offsets FROM e GROUP BY 1",
    "r08_quota": "WITH m AS (SELECT max(event_id) // 20 + 1 AS m FROM events), b AS (SELECT event_id // m AS b, user_id, max(value) - min(value) AS w FROM events, m GROUP BY 1, 2 HAVING max(value) - min(value) > 100), k AS (SELECT e.event_id, e.user_id, b.b FROM events e JOIN m ON true JOIN b ON e.event_id // m = b.b AND e.user_id = b.user_id), f AS (SELECT user_id, min(b) AS b, min(event_id) AS f FROM k GROUP BY 1), c AS (SELECT b, sum(count(*)) OVER (ORDER BY b) AS n FROM f GROUP BY 1), l AS (SELECT min(b) AS last FROM c WHERE n >= 60), q AS (SELECT user_id FROM f, l WHERE b <= last ORDER BY f LIMIT 60) SELECT event_id, user_id FROM k, l WHERE b <= last AND user_id IN (SELECT user_id FROM q)",
    "r17_renamed": "SELECT o_orderkey AS id, o_orderpriority AS question FROM orders",
    "r18_chat_prompts": "SELECT * FROM (VALUES ('chats', true), ('missing', false), ('numbers', false), ('empty', false)) t(\"check\", ok)",
    "j08_answered": "SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey) - 1 AS token_id, dense_rank() OVER (ORDER BY l_orderkey) - 1 AS row_id, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS sample_id, l_partkey AS response FROM lineitem",
    "j09_continued": "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders), e AS (SELECT row_id, i AS sample_id, o_orderkey || ':' || (o_custkey + i) % 10 AS full_text, ((o_custkey + i) % 10 = o_orderkey % 10)::INT::DOUBLE AS score, o_orderpriority AS t FROM o, range(3) r(i)) SELECT row_id, sample_id, full_text, score, round(avg(score) OVER (PARTITION BY t), 8) AS token_accuracy FROM e",
    "j12_repeats": "SELECT r % 100 AS row, CAST(sum(o_custkey) AS BIGINT) AS total FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) GROUP BY 1",
    "p31_payloads": "WITH d AS (SELECT event_id, props, strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM d WHERE day > (SELECT min(day) FROM d)",
    "p35_formatted": """SELECT o_orderkey // 64 AS batch, md5('[' || string_agg('{"prompt":"Order ' || o_orderkey || '"}', ',' ORDER BY o_orderkey) || ']') AS digest FROM orders GROUP BY 1""",
    "p44_generation_rows": "SELECT r * 3 + k AS row_id, o_orderkey, 'single_turn' AS agent_name FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), range(3) t(k)",
    "m16_interactions": "WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS t, max((role = 'tool')::INT) AS tool FROM conversations GROUP BY 1) SELECT conv_id, (t IS NOT NULL AND conv_id % 2 = 0)::INT::DOUBLE AS score, tool::DOUBLE AS tool FROM l",
}

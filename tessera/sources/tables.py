"""Sources and sinks: prompt, chat and preference tables, JSON-lines dumps by step, reports, reuse of results.

All readers declare or check schemas instead of inferring from data, and take any path that Hadoop's file systems know.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_prompts(spark: SparkSession, paths: Sequence[str], keys: Sequence[str], *, most: int | None = None, seed: int | None = None, max_length: int | None = None, length: Column | None = None) -> DataFrame:
    """All files in order of ``keys`` (a total order), optionally at most ``most`` rows - the first, or a seeded sample
    without replacement - and then those whose ``length`` is at most ``max_length``; a null length counts as too long."""
    df = spark.read.parquet(*paths)
    if most is not None:
        df = df.orderBy(*([F.xxhash64(F.lit(seed), *keys)] if seed is not None else []), *keys).limit(most)
    if max_length is not None:
        df = df.filter(F.coalesce(length, F.lit(max_length + 1)) <= max_length)
    return df


def nested(df: DataFrame, column: str, path: Sequence[str]) -> Column:
    """Descend through structs by name; arrays of one element are entered."""
    out, kind = F.col(column), df.schema[column].dataType
    for name in path:
        while isinstance(kind, T.ArrayType):
            out, kind = F.element_at(out, 1), kind.elementType
        out, kind = out[name], kind[name].dataType
    return out


def read_pairs(spark: SparkSession, paths: Sequence[str], prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return spark.read.parquet(*paths).select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def read_chats(spark: SparkSession, paths: Sequence[str], messages: str = "messages", tools: str = "tools", thinking: str = "enable_thinking") -> DataFrame:
    """Messages, and tools and the thinking flag as nulls where the files have no such column."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(F.col(messages).alias("messages"), get(tools).alias("tools"), get(thinking).alias("enable_thinking"))


def write_generations(df: DataFrame, path: str, step: str = "step") -> None:
    """One folder of JSON lines a step, so that readers prune by step."""
    df.write.mode("append").partitionBy(step).json(path)


def read_generations(spark: SparkSession, path: str, schema: T.StructType | str, mask: str | None = None, strings: Sequence[str] = ()) -> DataFrame:
    """JSON lines with a declared schema; strings may be masked by a pattern, each match becoming a star."""
    df = spark.read.schema(schema).json(path)
    return df.withColumns({c: F.regexp_replace(c, mask, "*") for c in strings}) if mask else df


def numbered_lines(spark: SparkSession, path: str, out: str = "idx") -> DataFrame:
    """file, ``out`` and value of all lines under a path: a line's number in its file, however files are split.

    A split counts its own lines as it reads them; what stands before it in its file are sums of a row a split, so no line
    is exchanged unless there are more splits than a broadcast may hold.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for b in batches:
            numbers = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = seen + 1 if key == held else 0
                held = key
                numbers.append(seen)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], ["file", "_at", "value", "_in"])

    numbered = lines.mapInArrow(run, "file string, _at long, value string, _in long")
    sizes = lines.groupBy("file", "_at").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("_base", before).drop("_n")
    return numbered.join(bases, ["file", "_at"]).select("file", (F.col("_base") + F.col("_in")).alias(out), "value")


def viewed_rows(lines: DataFrame, schema: T.StructType | str, mask: str | None = None) -> DataFrame:
    """The fields of JSON lines (column value) as text: strings with what the pattern matches as a star, others as JSON.

    Other columns stay; a line that is no JSON has nulls.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kept = [c for c in lines.columns if c != "value"]
    rows = lines.select(*kept, F.from_json("value", fields).alias("_r"))

    def text(f: T.StructField) -> Column:
        x = F.col("_r")[f.name]
        if isinstance(f.dataType, T.StringType):
            return F.regexp_replace(x, mask, "*") if mask else x
        return F.to_json(x) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else x.cast("string")

    return rows.select(*kept, *[text(f).alias(f.name) for f in fields.fields])


def write_dual(df: DataFrame, path: str) -> None:
    """The same rows as Parquet and as JSON lines; the second is written from the first."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet").write.mode("overwrite").json(f"{path}/jsonl")


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Structs as columns with joined names."""

    def walk(fields, prefix, base):
        for f in fields:
            col = base[f.name] if base is not None else F.col(f"`{f.name}`")
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, f"{name}{sep}", col)
            else:
                yield col.alias(name)

    return df.select(*walk(df.schema.fields, "", None))


def metric_lines(df: DataFrame, step: str, metrics: Sequence[str]) -> DataFrame:
    """A JSON line of step and data for each row, for a text sink."""
    return df.select(F.to_json(F.struct(F.col(step).alias("step"), F.struct(*metrics).alias("data"))).alias("value"))


def reuse(spark: SparkSession, root: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table written earlier under this configuration, else make and write it."""
    path = f"{root.rstrip('/')}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:24]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_frame(df: DataFrame, meta: dict, path: str) -> None:
    """A batch as Parquet with its meta beside it, as JSON (never pickles)."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_frame(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


# --- queries ---
def s01_read_prompts(spark, sf_dir):
    return read_prompts(spark, [f"{sf_dir}/documents.parquet"], ["doc_id"], max_length=2000, length=F.col("n_chars")).select("doc_id", "n_chars")


def s20_offline_scores(spark, sf_dir):
    """Scan of response, source and truth for offline scoring, with the columns pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "source", F.char_length("text").alias("length"))


def s12_masked(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.md5(F.regexp_replace("text", "[aeiou]", "*")).alias("masked"))


def s12_file_rows(spark, sf_dir):
    """Orders as JSON lines in five files: each line's place in its file, and its fields as text."""
    from ..session import shared_path

    root = shared_path(spark, "lines")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", F.struct("o_custkey", F.array("o_orderstatus").alias("states")).alias("extra"), (F.col("o_orderkey") % 5).alias("part"))
    o.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").json(root)
    rows = viewed_rows(numbered_lines(spark, root), "o_orderkey long, o_orderpriority string, extra struct<o_custkey: long, states: array<string>>", mask="[0-9]-")
    return rows.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "idx", "o_orderkey", "o_orderpriority", "extra")


def s16_metric_lines(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 1000").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("user_id").alias("top"))
    return metric_lines(e, "step", ["n", "top"])


def s18_flattened(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("state")).alias("order"))
    return flattened(o)


QUERIES = {f.__name__: f for f in (s01_read_prompts, s20_offline_scores, s12_file_rows, s12_masked, s16_metric_lines, s18_flattened)}
ORACLES = {
    "s01_read_prompts": "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000",
    "s20_offline_scores": "SELECT doc_id, source, length(text)::INT AS length FROM documents",
    "s12_file_rows": """SELECT o_orderkey % 5 AS part, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) - 1 AS idx, o_orderkey::VARCHAR AS o_orderkey, '*' || o_orderpriority[3:] AS o_orderpriority, '{"o_custkey":' || o_custkey || ',"states":["' || o_orderstatus || '"]}' AS extra FROM orders""",
    "s12_masked": "SELECT conv_id, turn, md5(regexp_replace(text, '[aeiou]', '*', 'g')) AS masked FROM conversations",
    "s16_metric_lines": """SELECT '{"step":' || (event_id // 1000) || ',"data":{"n":' || count(*) || ',"top":' || max(user_id) || '}}' AS value FROM events GROUP BY event_id // 1000""",
    "s18_flattened": 'SELECT o_orderkey AS "order/key", o_orderstatus AS "order/state/status" FROM orders',
}

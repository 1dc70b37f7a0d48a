"""Dumps by step as a Spark data source: ``spark.read.format("steps")``, ``df.write.format("steps")`` and streams of steps.

A dump is a folder of JSON lines, one file a step and task, named ``<step>-<task>-<id>.jsonl``, and of commits: a write's
files count once the write's list of them stands in ``_commits``, which is one small file.  A write that fails leaves
nothing that a reader sees, and its files go.  Steps are read by file, filters on ``step`` choose the files before any is
opened, and a stream's offset is the number of commits that it has seen.

Paths are those of pyarrow's file systems (local, HDFS, S3, GCS), as readers and writers run in Python on the executors.
"""

from __future__ import annotations

import json
import operator
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import shared_path

# classes travel by value: Python processes beside the driver, which plan and drive streams, have no added files
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines that a reader turns into one batch.
BATCH_LINES = 2000
COMMITS = "_commits"
#: Files that a task writes at once; where its rows are of more steps, a step has several files.
OPEN_FILES = 64
#: Files, and lines of theirs, that one task reads.
TASK_FILES, TASK_LINES = 512, 100_000
#: Filters that choose files, by the names of their classes.
COMPARED = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda step, values: step in values}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class StepFile(InputPartition):
    step: int
    name: str
    lines: int = 0


@dataclass
class StepFiles(InputPartition):
    """What one task reads, file by file."""

    files: list[StepFile]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # step, name and number of lines


def _commits(path: str) -> list[str]:
    """Names of the commits, in their order."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def _files(path: str, commits: Iterable[str]) -> list[StepFile]:
    store, root = _store(path)
    out = []
    for name in commits:
        with store.open_input_stream(f"{root}/{COMMITS}/{name}") as f:
            out += [StepFile(*file) for file in json.loads(f.read())]
    return sorted(out, key=lambda f: (f.step, f.name))


def _tasks(files: Iterable[StepFile]) -> list[StepFiles]:
    """Consecutive files for a task, as small ones are not worth one each."""
    out, lines = [], 0
    for f in files:
        if not out or len(out[-1].files) == TASK_FILES or lines + f.lines > TASK_LINES:
            out.append(StepFiles([]))
            lines = 0
        out[-1].files.append(f)
        lines += f.lines
    return out


def _rows(path: str, schema: StructType, file: StepFile) -> Iterator[pa.RecordBatch]:
    """A file's lines in their order, as batches; columns that a line lacks are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    store, root = _store(path)
    kinds, lines = to_arrow_schema(schema), []
    with store.open_input_stream(f"{root}/{file.name}") as f, pa.BufferedInputStream(f, 1 << 20) as b:
        for line in _lines(b):
            lines.append({**json.loads(line), "step": file.step})
            if len(lines) == BATCH_LINES:
                yield pa.RecordBatch.from_pylist(lines, kinds)
                lines = []
    if lines:
        yield pa.RecordBatch.from_pylist(lines, kinds)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class StepReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what compares the step with constants; the rest is Spark's."""
        for f in filters:
            if type(f).__name__ in COMPARED and f.attribute == ("step",):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, step: int) -> bool:
        return all(COMPARED[k](step, v) for k, v in self.tests)

    def partitions(self) -> list[StepFiles]:
        return _tasks(f for f in _files(self.path, _commits(self.path)) if self._wanted(f.step))

    def read(self, partition: StepFiles) -> Iterator[pa.RecordBatch]:
        for file in partition.files if partition else ():  # None where no file is wanted
            yield from _rows(self.path, self.schema, file)


class StepStreamReader(DataSourceStreamReader):
    """Each trigger has what was committed since the last one; the offset is a number of commits."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commits": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commits": len(_commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[StepFiles]:
        return _tasks(_files(self.path, _commits(self.path)[start["commits"] : end["commits"]]))

    def read(self, partition: StepFiles) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield from _rows(self.path, self.schema, file)


class StepWriter(DataSourceArrowWriter):
    """Files by step and task; a step's rows keep their order within a task."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _store(self.path)
        store.create_dir(root)
        task, open_, counts = TaskContext.get().partitionId(), {}, {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    step = row.pop("step")
                    if step is None:
                        raise ValueError("a row has no step")
                    if step not in open_:
                        if len(open_) == OPEN_FILES:
                            self._close(open_)
                        name = f"{step}-{task}-{self.job[:12]}-{uuid.uuid4().hex[:8]}.jsonl"
                        open_[step] = name, store.open_output_stream(f"{root}/{name}")
                    name, stream = open_[step]
                    stream.write((json.dumps(row, ensure_ascii=False, default=str) + "\n").encode())
                    counts[step, name] = counts.get((step, name), 0) + 1
        finally:
            self._close(open_)
        return Written([(step, name, n) for (step, name), n in counts.items()])

    @staticmethod
    def _close(held: dict) -> None:
        for _, stream in held.values():
            stream.close()
        held.clear()

    def commit(self, messages: list[Written | None]) -> None:
        """One list of all files; its number says its place among the commits."""
        store, root = _store(self.path)
        store.create_dir(f"{root}/{COMMITS}")
        files = [f for m in messages if m for f in m.files]
        name = f"{root}/{COMMITS}/{len(_commits(self.path)):09d}-{self.job}"
        with store.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(files).encode())
        store.move(f"{name}.part", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """The job's files go, also those of tasks that failed."""
        from pyarrow import fs

        store, root = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f"-{self.job[:12]}-" in f.base_name:
                store.delete_file(f.path)


class StepSource(DataSource):
    """Options: path.  Reading takes a schema with a column step; writing takes rows with one."""

    @classmethod
    def name(cls) -> str:
        return "steps"

    def schema(self) -> str:
        return "input string, output string, score double, step long"

    def reader(self, schema: StructType) -> StepReader:
        return StepReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StepStreamReader:  # noqa: N802
        return StepStreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> StepWriter:
        if overwrite:
            raise ValueError("steps are appended; write another version to another path")
        if "step" not in schema.names:
            raise ValueError("the rows have no column step")
        return StepWriter(self.options["path"])


def with_steps(spark: SparkSession) -> SparkSession:
    """The session with the source registered."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StepSource)
    return spark


def write_steps(df: DataFrame, path: str) -> None:
    """All rows to files by their step, each step in one task unless one is told to be in more."""
    with_steps(df.sparkSession)
    df.write.format("steps").mode("append").save(path)


def read_steps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed rows, with the columns of ``schema``; filters on step choose files."""
    return with_steps(spark).read.format("steps").schema(schema).load(path)


# --- queries ---
def _generations(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("input"), F.col("o_orderpriority").alias("output"), F.col("o_totalprice").cast("double").alias("score"), F.struct(F.col("o_custkey").alias("customer"), F.array("o_orderstatus").alias("states")).alias("extra"), (F.col("o_orderkey") % 37).alias("step"))


_SCHEMA = "input long, output string, score double, extra struct<customer: long, states: array<string>>, step long"


def s13_steps(spark, sf_dir):
    """All orders as dumps of 37 steps, in two writes, and back."""
    path, rows = shared_path(spark, "steps"), _generations(spark, sf_dir)
    write_steps(rows.filter("step % 2 = 0").repartition("step"), path)
    write_steps(rows.filter("step % 2 = 1").repartition(3), path)
    return read_steps(spark, path, _SCHEMA).select("step", "input", "output", "score", "extra.customer", F.col("extra.states")[0].alias("state"))


def s10_pruned_steps(spark, sf_dir):
    """What the files of a range of steps hold; no other file is opened."""
    path = shared_path(spark, "steps")
    write_steps(_generations(spark, sf_dir), path)
    return read_steps(spark, path, _SCHEMA).filter("step >= 10 AND step < 20 AND score > 0").groupBy("step").agg(F.count("*").alias("n"), F.sum("input").alias("inputs"))


def s19_steps_streamed(spark, sf_dir):
    """Two commits, each seen by its own run of one restartable stream."""
    root, rows = shared_path(spark, "steps"), _generations(spark, sf_dir)
    for part in range(2):
        write_steps(rows.filter(F.col("step") % 2 == part), f"{root}/dump")
        stream = with_steps(spark).readStream.format("steps").schema(_SCHEMA).load(f"{root}/dump")
        q = stream.select("input", "step", "extra.customer").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        q.awaitTermination()
    return spark.read.schema("input long, step long, customer long").parquet(f"{root}/out")


def s16_metric_dump(spark, sf_dir):
    """Metrics of steps as lines of step and data, in one file a step."""
    path = shared_path(spark, "metrics")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 250").alias("step")).agg(F.count("*").alias("n"), F.max("user_id").alias("top"))
    write_steps(e.select("step", F.struct("n", "top").alias("data")).repartition("step"), path)
    return read_steps(spark, path, "data struct<n: long, top: long>, step long").select("step", "data.n", "data.top")


QUERIES = {f.__name__: f for f in (s10_pruned_steps, s13_steps, s16_metric_dump, s19_steps_streamed)}
ORACLES = {
    "s13_steps": "SELECT o_orderkey % 37 AS step, o_orderkey AS input, o_orderpriority AS output, o_totalprice::DOUBLE AS score, o_custkey AS customer, o_orderstatus AS state FROM orders",
    "s10_pruned_steps": "SELECT o_orderkey % 37 AS step, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS inputs FROM orders WHERE o_orderkey % 37 BETWEEN 10 AND 19 AND o_totalprice > 0 GROUP BY 1",
    "s19_steps_streamed": "SELECT o_orderkey AS input, o_orderkey % 37 AS step, o_custkey AS customer FROM orders",
    "s16_metric_dump": "SELECT event_id // 250 AS step, count(*) AS n, max(user_id) AS top FROM events GROUP BY 1",
}

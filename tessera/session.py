"""What a session needs: the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker is handed at once; whole texts are long.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their workers import its modules.

    Where the session still has Spark's default for the rows of an Arrow batch, it gets ``BATCH_ROWS``: ten thousand whole
    texts at once are a large part of a worker's memory.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``; set here only if unset).

    A temporary folder will do only where the executors are threads of this process; elsewhere one must be named.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files at its end, and hands Python smaller batches of rows."""
    with_these = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", ARROW_ROWS: str(BATCH_ROWS)}
    before = {k: spark.conf.get(k) for k in with_these}
    try:
        for k, v in with_these.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, *, compact: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back (survives lost executors).

    The shuffle files of the write go with its end, as nothing will read them again.  Small tables of many tasks become
    few files by one more exchange; ``compact=False`` spares it where the table is large, or where its rows hold numbers
    that a second run of a task might give otherwise.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with freed(spark):
        (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

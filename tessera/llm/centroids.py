"""Lloyd's rounds in integers: every distance, sum and centroid is exact, so reruns and any partitioning agree.

Components become integers floor(scale * x).  Squared distances come from |x|^2 - 2 x.c + |c|^2 with one matrix product
for a block of vectors: all numbers in it are integers, and as long as none can reach 2^53 a float64 BLAS gives them exactly
in any order of additions.  Magnitudes are bounded before: vectors and centroids beyond the bound take integer
arithmetic (int64 where that is wide enough, else Python's).

A round is one scan: each task adds up its vectors by centroid, and RDD.treeAggregate combines these few numbers on the
executors.  Nothing is exchanged but one row of sums a task, and the driver gets k * (dims + 1) integers a round.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, written

#: Below this all integers are exact in float64, and in int64.
EXACT_FLOAT, EXACT_LONG = 1 << 53, 1 << 63
LONG_MAX = EXACT_LONG - 1
#: Vectors in one matrix product.
BLOCK_ROWS = 4096


def usable(vectors: DataFrame, *, key: str, vector: str, dims: int) -> DataFrame:
    """key and vector of the rows whose vector has exactly ``dims`` components, none null or non-finite."""
    x = F.col(f"`{vector}`")
    if not isinstance(vectors.schema[vector].dataType.elementType, (T.FloatType, T.DoubleType)):
        x = x.cast("array<double>")
    good = (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(f"`{key}`").alias("key"), x.alias("x")).filter(good)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as float64 (exact integers) where the product is finite, else as Python integers.

    ``scale`` is a power of two, so the product is exact.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(x.astype(np.float64) * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(s) if isfinite(s) else int(v) * scale for v, s in zip(row, to, strict=True)] for row, to in zip(x, scaled, strict=True)], object).reshape(x.shape)


def _whole(x: np.ndarray, dtype) -> np.ndarray:
    """Integers of ``dtype`` (int64 or object) of an array of integers kept as float64 or as Python integers."""
    if dtype is object and x.dtype != object:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(dtype)


def _tops(x: np.ndarray) -> np.ndarray:
    """The largest magnitude of each row, as Python integers where float64 does not hold them."""
    return np.abs(x).max(axis=1) if len(x) else np.zeros(0)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows and centres (float64 integers or Python integers): int64 or object."""
    dims = x.shape[1]
    bound = int((EXACT_FLOAT // dims) ** 0.5) // 2  # then dims * (|x| + |c|)^2 stays below 2^53
    near_x, near_c = _tops(x) < bound, _tops(centres) < bound
    if near_x.all() and near_c.all():
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    top = int(_tops(x).max()) + int(_tops(centres).max())
    kind = np.int64 if dims * top * top < EXACT_LONG else object
    out = np.zeros((len(x), len(centres)), kind)
    if near_x.any() and near_c.any():
        out[np.ix_(near_x, near_c)] = squared_distances(x[near_x], centres[near_c])
    wide_x, wide_c = _whole(x, kind), _whole(centres, kind)
    for j in range(len(centres)):
        rows = ~near_x if near_c[j] else np.ones(len(x), bool)
        d = wide_x[rows] - wide_c[j]
        out[rows, j] = (d * d).sum(axis=1)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (ties: the smaller number) and its squared distance."""
    d = squared_distances(x, centres)
    to = d.argmin(axis=1)
    return to, d[np.arange(len(d)), to]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            b = batch.slice(at, BLOCK_ROWS)
            yield b.column(0), integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def _add(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def sums_by_centre(vectors: DataFrame, centres: list[list[int]], scale: int) -> list[int]:
    """For each centre its number of vectors and the sum of each component, back to back, as exact integers."""
    k, dims, held = len(centres), len(centres[0]), _held(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (k * (dims + 1))
        for _, x in _blocks(batches, dims, scale):
            to, _ = nearest(x, held)
            for j in np.unique(to).tolist():
                rows = x[to == j]
                small = rows.dtype != object and float(np.abs(rows).max()) * len(rows) < EXACT_FLOAT
                sums = rows.sum(axis=0) if small else _whole(rows, object).sum(axis=0)
                total[j * (dims + 1) : (j + 1) * (dims + 1)] = _add(total[j * (dims + 1) : (j + 1) * (dims + 1)], [len(rows), *map(int, sums)])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(total)], pa.binary())})

    parts = vectors.mapInArrow(lean(run), "sums binary").rdd.map(lambda r: pickle.loads(bytes(r["sums"])))
    return parts.treeAggregate([0] * (k * (dims + 1)), _add, _add, depth=2)


def _held(centres: list[list[int]]) -> np.ndarray:
    """The centres as float64 where that holds them, else as Python integers."""
    if max(abs(v) for c in centres for v in c) < EXACT_FLOAT:
        return np.array(centres, np.float64)
    return np.array(centres, object)


def first_centres(vectors: DataFrame, *, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:key`` (null keys last; ties: the smaller vector), k rows at most."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "x").orderBy(F.col("rank").asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in integers(np.array([r["x"]], np.float64), scale)[0]] for r in rows]


def clustered(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """A row a kept vector: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a null vector is left out.  Every row counts,
    also with an equal or null key.  With fewer than k kept vectors there are as many centroids; with none no rows.
    ``centroid_sha256`` is that of the final centroid's components in decimal, joined by commas.  Components may be as
    large as a double can be; a distance or sum beyond a long is given as the largest long, though assigned exactly.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    spark = vectors.sparkSession
    rows = written(usable(vectors, key=key, vector=vector, dims=dims), "vectors", compact=False)
    centres = first_centres(rows, k=k, seed=seed, scale=scale)
    for _ in range(rounds if centres else 0):
        sums = sums_by_centre(rows, centres, scale)
        for j in range(len(centres)):
            n, *total = sums[j * (dims + 1) : (j + 1) * (dims + 1)]
            if n:
                centres[j] = [t // n for t in total]
    held = _held(centres) if centres else np.zeros((0, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _blocks(batches, dims, scale):
            to, d = nearest(x, held)
            d = d if d.dtype == np.int64 else np.array([min(int(v), LONG_MAX) for v in d], np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(to.astype(np.int32)), pa.array(d)], ["key", "cluster", "distance"])

    kind = T.StructType([rows.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = written(rows.mapInArrow(lean(run), kind), "assigned", compact=False)
    wide = F.sum(F.col("distance").cast("decimal(20,0)"))
    found = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(wide.alias("total")).collect()}  # k rows
    discard(rows)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole = min(LONG_MAX, sum(found.values()))
    told = [(j, min(LONG_MAX, found.get(j, 0)), whole, digest[j]) for j in range(len(centres))]
    named = spark.createDataFrame(told, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(named), F.col("cluster") == F.col("_cluster"))
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

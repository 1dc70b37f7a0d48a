"""Shared helpers: the cluster's shared folder, written tables, and byte-level text blocks for numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path, written  # noqa: F401

#: Texts are handled in blocks of about this many bytes, which bounds a worker's memory (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def ranges_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Number of ranges to deal ``df`` out to: the session's, or more where its files hold over ``each`` bytes a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(n, min(told // each, 100 * n))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing will read them again."""
    for df in tables:
        if files := df.inputFiles():
            remove_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the bit map of ``bit_words``: its rows are 2^18 at most, whatever it is made from.
MAP_BITS = 24


def _bit(hashes: Column) -> tuple[Column, Column]:
    at = F.pmod(hashes, F.lit(1 << MAP_BITS))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def bit_words(table: DataFrame, hashes: Column) -> DataFrame:
    """word, bits: a bit map of fixed size of the hashes, to be broadcast; rows that it shows may be in the table."""
    word, bit = _bit(hashes)
    return written(table.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "bits")


def may_be_in(df: DataFrame, words: DataFrame, hashes: Column, out: str) -> DataFrame:
    """``df`` with ``out``: false where the hash is surely not in the table that ``words`` was made from."""
    word, bit = _bit(hashes)
    met = df.join(F.broadcast(words), word == F.col("_word"), "left")
    return met.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def store_of(uri: str):
    """(file system, path in it) of a place in the shared folder, for what workers write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A worker's function that gives back, at its task's end, the memory that its process holds but does not use."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back and their offsets (n + 1); null counts as empty."""
    arr = pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else "")
    arr = arr if pa.types.is_large_binary(arr.type) else arr.cast(pa.large_string())
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: The white space that parts words: a blank and \t \n \v \f \r.
SPACE = byte_class(b" \t\n\v\f\r")
#: Bytes of words without punctuation: ASCII letters and digits and all of UTF-8's other bytes.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that never cross a document's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(inside))]
    start[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPANS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, seed: int) -> list[np.ndarray]:
    """Codes of the bytes, and powers of an odd base and of its inverse, modulo 2^64; all of them follow from the seed."""
    known = _SPANS.get(seed)
    if known is None or len(known[1]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = mix_int(seed + 0x9E3779B97F4A7C15) | 1
        known = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))]
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            known.append(np.multiply.accumulate(p))
        while len(_SPANS) > 1:  # seeds of runs that are over; two are in use at most
            _SPANS.pop(next(iter(_SPANS)))
        _SPANS[seed] = known
    return [known[0], known[1][:n], known[2][:n]]


#: Bytes whose spans are hashed at once, where they begin in order: the tables of powers stay as small for any text.
SPAN_BLOCK = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes (polynomial prefix sums modulo 2^64, then mixed with the length)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * SPAN_BLOCK and (starts[1:] >= starts[:-1]).all():
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = int(np.searchsorted(starts, starts[i] + SPAN_BLOCK, side="right"))
            base, top = int(starts[i]), int(ends[i:j].max())
            out[i:j] = _span_hashes(data[base:top], starts[i:j] - base, ends[i:j] - base, seed)
            i = j
        return out
    return _span_hashes(data, starts, ends, seed)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    code, up, down = _powers(max(1, len(data)), seed)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[np.minimum(starts, len(down) - 1)] + (ends - starts).astype(np.uint64))


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (2**64 - 1)], np.uint64))[0])

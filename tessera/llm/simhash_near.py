"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has ``bits`` bits (XXH64 of every shingle votes on them; further 64 bits come from further seeds).  Two
fingerprints within ``radius`` differ, cut into ``radius // 2 + 1`` segments, by at most one bit in some segment.  So
each distinct fingerprint is indexed once for each bit of each segment with that bit left out (a wildcard): those that
agree in all other bits of the segment meet under an equal key, and the full distance is verified there.

Copies with equal fingerprints are one class before anything is indexed.  A key's members are never paired up in the
output: a bucket of more than a few gives a minimum spanning forest of its links, one row less than it has members at
most, and large buckets are cut by the pigeonhole principle into smaller ones, exactly.  Components come from alternating large
and small stars on distributed edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, lean, written

SEED = 42
#: Buckets up to this size are compared row by row; larger ones are first cut by equal pieces of the fingerprint.
DENSE = 4096
#: Distances made at once in a bucket, and the size up to which all of a bucket's links come out.
BLOCK_PAIRS = 1 << 19
SMALL = 5


def fingerprint(text: str, shingle: int, bits: int = 64) -> bytes:
    """Big-endian fingerprint of a text: bit set where over half of the shingles' hashes have it set."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(bits // 8)
    joined, k = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[k - 1 :].tolist()
    n, votes = len(ends), np.zeros(bits, np.int64)
    starts = starts[:n].tolist()
    for at in range(0, n, 1 << 15):
        grams = [joined[s:e] for s, e in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)]
        seeds = [np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(SEED + i))), np.uint64) for i in range(bits // 64)]
        votes += np.unpackbits(np.stack(seeds, 1).astype(">u8").view(np.uint8).reshape(len(grams), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > n).tobytes()


def fingerprints(docs: DataFrame, *, text: str, key: str, shingle: int, bits: int) -> DataFrame:
    """_key and fp (binary).  A null text is empty; its fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text"):
            prints = [fingerprint(t, shingle, bits) for t in pc.fill_null(b.column("_text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(prints, pa.binary())], ["_key", "fp"])

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(lean(run), "_key long, fp binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _boruvka(prints: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """Minimum spanning forest (i, j, distance): every component takes its closest link out, until none is left.

    Distances are made for a block of rows at a time and never kept.
    """
    n, out = len(prints), []
    union, part = _Union(n), np.arange(n)
    step = max(1, BLOCK_PAIRS // n)
    while True:
        best, to = np.full(n, radius + 1, np.int16), np.zeros(n, np.int64)
        for at in range(0, n, step):
            d = _distance(prints[at : at + step, None], prints[None])
            d[part[at : at + step, None] == part[None]] = radius + 1
            to[at : at + step] = d.argmin(1)
            best[at : at + step] = d.min(1)
        rows = np.flatnonzero(best <= radius)
        if not len(rows):
            return out
        rows = rows[np.lexsort((rows, best[rows], part[rows]))]
        rows = rows[np.r_[True, part[rows][1:] != part[rows][:-1]]]
        for i in rows.tolist():
            if union.join(i, int(to[i])):
                out.append((i, int(to[i]), int(best[i])))
        part = np.array([union.root(i) for i in range(n)])


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
    """A spanning forest of the links (distance <= radius) among rows of ``prints`` (uint64 words), close links first.

    Many rows are first cut by each of radius + 1 pieces of the fingerprint: linked rows agree in some piece, so the
    pieces' forests together connect what all links connect.
    """
    n = len(prints)
    if n <= DENSE:
        return _boruvka(prints, radius)
    bit, found = np.unpackbits(prints.view(np.uint8).reshape(n, -1), axis=1), []
    for piece in np.array_split(np.arange(bit.shape[1]), radius + 1):
        codes = np.packbits(bit[:, piece], axis=1)
        order = np.lexsort(codes.T[::-1])
        cut = np.flatnonzero(np.r_[True, (codes[order][1:] != codes[order][:-1]).any(1), True])
        if len(cut) == 2:  # all agree in this piece: it decides nothing, and alone would connect everything
            return _boruvka(prints, radius)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                rows = order[lo:hi]
                found += [(int(rows[i]), int(rows[j]), d) for i, j, d in _boruvka(prints[rows], radius)]
    union = _Union(n)
    return [x for x in sorted(found, key=lambda x: (x[2], x[0], x[1])) if union.join(x[0], x[1])]


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut only between its values; binary columns become rows of uint64 words."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                new.append(np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1))
            else:
                new.append(c.to_numpy(zero_copy_only=False))
        last = int(np.searchsorted(new[0], new[0][-1]))  # the last group may go on
        if last or held and held[-1][0][-1] != new[0][0]:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in new], strict=True)]
            held = []
        held.append([c[last:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(classes: DataFrame, *, bits: int, radius: int, small: int = SMALL) -> DataFrame:
    """Distinct links a > b between classes: all of them in buckets of up to ``small`` rows, in larger ones a minimum
    spanning forest.  ``classes``: rep (long) and fp (binary), both distinct.
    """
    width = np.array_split(np.arange(bits), radius // 2 + 1)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bit = np.unpackbits(raw, axis=1).astype(np.uint64)
                keys = []
                for k, segment in enumerate(width):
                    value = (bit[:, segment] << np.arange(len(segment), dtype=np.uint64)).sum(1, dtype=np.uint64)
                    for j in range(len(segment)):  # the bit is cleared, and its place is part of the key
                        keys.append((value & ~np.uint64(1 << j)) ^ np.uint64(((k * 64 + j) << 48) if len(segment) <= 48 else 0))
                keys = np.stack(keys, 1)
                rows = np.repeat(np.arange(b.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), b.column("rep").take(pa.array(rows)), b.column("fp").take(pa.array(rows))], ["key", "rep", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, reps, prints in sorted_groups(batches):
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cut)
            size = np.repeat(sizes, sizes)
            a, b = [], []
            for k in range(1, small):  # all pairs of small buckets, by how far apart they stand
                i = np.flatnonzero((keys[k:] == keys[:-k]) & (size[k:] <= small)) if len(keys) > k else np.zeros(0, np.int64)
                i = i[_distance(prints[i], prints[i + k]) <= radius]
                a.append(reps[i])
                b.append(reps[i + k])
            for lo, n in zip(cut[:-1][sizes > small], sizes[sizes > small], strict=True):
                if tree := forest(prints[lo : lo + n], radius):
                    i, j, _ = np.array(tree).T + lo
                    a.append(reps[i])
                    b.append(reps[j])
            pairs = _pairs(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    keyed = classes.select("rep", "fp").mapInArrow(lean(variants), "key long, rep long, fp binary")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(verify), "a long, b long").distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the larger number first."""
    pairs = np.stack([np.maximum(a, b), np.minimum(a, b)], 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def star_links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links (larger, smallest) that connect each end with the smallest of those that the given links connect it with."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    union = _Union(len(ends))
    for i, j in zip(*np.split(at, 2), strict=True):
        union.join(int(i), int(j))
    heads = np.array([union.root(i) for i in range(len(ends))], np.int64)
    pairs = np.stack([ends, ends[heads]], 1) if len(ends) else np.zeros((0, 2), np.int64)
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, *, name: str = "stars", stars: bool = False) -> DataFrame:
    """node, component (smallest node reachable, itself included) of every node of the edges a > b, by alternating stars.

    Where the edges (distinct ones) are most likely ``stars`` already, one round shows it.
    """
    given, seen = edges, _mark(edges) if stars else None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, name)
        if edges is not given:
            discard(edges)
        mark = _mark(new)
        edges = new
        if mark == seen:
            ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.union(ends.select("component", "component").distinct())
        seen = mark


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 64, radius: int = 2) -> DataFrame:
    """A row a document: ``key``, fingerprint (hex), component_id (the smallest key reachable over links).

    Lower-cases A-Z, parts words at blanks and \\t-\\r, takes word shingles with repeats.  Texts without words, empty
    and null ones have the zero fingerprint and link like any other; equal rows are one class, rows with equal keys and
    other texts are not; null keys are kept, link like others, and name a component (null) only where it has no other;
    an empty table gives no rows; extra columns are ignored.
    """
    prints = written(fingerprints(docs, text=text, key=key, shingle=shingle, bits=bits), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("_key").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "classes", compact=False)
    found = written(links(classes, bits=bits, radius=radius), "links")
    parts = components(found)
    discard(found)
    named = _named(classes, parts).select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("_key").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _named(classes: DataFrame, parts: DataFrame) -> DataFrame:
    """The classes (rep, least) with component (null where nothing is linked) and component_id, its smallest key."""
    linked = classes.join(parts, classes["rep"] == parts["node"], "left").drop("node")
    heads = linked.filter("component is not null").groupBy("component").agg(F.min("least").alias("_head")).withColumnRenamed("component", "_c")
    return linked.join(heads, F.col("component") == F.col("_c"), "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("_head"))).drop("_c", "_head")

"""HyperMinHash near-duplicates: documents whose sets of word shingles have a Jaccard likeness of ``least`` or more.

1. A set's hashes fall into ``BUCKETS`` buckets; a bucket keeps of its smallest hash the number of leading zeros (6 bits)
   and ``MANTISSA`` bits behind the first one: a register of 16 bits.  Equal sets are one class from here on.
2. Four registers side by side are one 64-bit band key.  Two sets of likeness 0.8 miss each other in all 32 bands with a
   probability of 5e-8.  Sets too small for that (up to ``TINY`` shingles) meet exactly: under their rarest shingles, one of
   which any like set shares.
3. Sets under one key are candidates if the likeness that their registers show, corrected for collisions, is less than
   ``deviations`` standard deviations below ``least`` (None: whatever it shows).  A key sends a spanning forest of its
   candidates, never all pairs.  Keys are counted first; of a key with more than ``LIMIT`` sets these meet anew under each
   second band in common, and what is still so large becomes a star, by an aggregation, without coming together.
4. Candidates' components are clouds, which no link leaves.  Their full sets meet in tasks of bounded size and are compared
   exactly (see ``near_copies.verified_links``); the links' components are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_words, blocks, discard, lean, may_be_in, mix64, written
from .near_copies import TEXT_BYTES, gram_sets, in_blocks, shingled, verified_links
from .simhash_near import _named, _pairs, components, sorted_groups

BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
#: Sets up to this size meet under shingles, larger ones under bands (sets of 0.8 of it and more under both).
TINY = 24
#: Sets that one task compares under one key.
LIMIT = 2048
#: Under a key with up to so many sets all candidates come out.
SMALL = 4
#: Hashes of bands; fixed, so that reruns agree.
SEED = 11


def compressed(rest: np.ndarray) -> np.ndarray:
    """16-bit registers of 53-bit hashes: 53 less the leading zeros, and the ``MANTISSA`` bits behind the first one.

    float64 holds 53 bits exactly and keeps them in just this way: its exponent counts the zeros, its fraction follows.
    Smaller hashes never have larger registers; no register is zero, which stands for an empty bucket.
    """
    held = (rest | np.uint64(1)).astype(np.float64).view(np.uint64)
    return ((held >> np.uint64(52 - MANTISSA)) - np.uint64(1022 << MANTISSA)).astype(np.uint16)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, BUCKETS) registers of sets of distinct hashes, each ascending, back to back."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.uint16)
    cell = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * BUCKETS + (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    out.ravel()[cell[first]] = compressed((hashes[first] << np.uint64(7)) >> np.uint64(11))
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, BANDS) keys, and whether any register of the band holds something."""
    words = np.ascontiguousarray(regs).view("<u8").astype(np.uint64)
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    return mix64(words ^ salt), words != 0


def likeness(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Jaccard likeness that registers of sets of n and m shingles show, and on how many registers it rests.

    Registers of different hashes collide if the hashes fall into one cell of the compression, whose width is, on average,
    2^-MANTISSA / (2 ln 2) of their size: with exponential minima of rates n and m that is nm / (n + m)^2 of that width.
    """
    both = np.count_nonzero((a == b) & (a != 0), axis=-1)
    used = np.count_nonzero(a | b, axis=-1)
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    chance = used * n * m / (n + m) ** 2 * 2.0**-MANTISSA / (2 * np.log(2))
    return (both - chance) / np.maximum(used - chance, 1e-9), used


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float, deviations: float | None) -> np.ndarray:
    """Whether sets may reach ``least``: by their sizes, and by their registers to ``deviations`` standard deviations."""
    sizes = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
    if deviations is None:
        return sizes
    seen, used = likeness(a, b, n, m)
    return sizes & (seen >= least - deviations * np.sqrt(least * (1 - least) / np.maximum(used, 1)))


def sketched(texts: DataFrame, *, shingle: int) -> DataFrame:
    """For rows _k, _h, _t: _k, _h, digest (of the set), n (its size), regs (binary) and few (a tiny set's hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_t", TEXT_BYTES):
            h, offsets, _ = shingled(b.column("_t"), shingle, SEED)
            raw, n, regs = h.tobytes(), np.diff(offsets), registers(h, offsets)
            digests = [hashlib.md5(raw[8 * lo : 8 * hi]).digest() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            tiny = np.where(n <= TINY, n, 0)
            few = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tiny)].astype(np.int32)), pa.array(h[np.repeat(tiny > 0, n)].view(np.int64)))
            columns = [b.column("_k"), b.column("_h"), pa.array(digests, pa.binary()), pa.array(n), pa.array([r.tobytes() for r in regs], pa.binary()), few]
            yield pa.RecordBatch.from_arrays(columns, ["_k", "_h", "digest", "n", "regs", "few"])

    return texts.mapInArrow(lean(run), "_k long, _h long, digest binary, n long, regs binary, few array<long>")


def banded(sets: DataFrame) -> DataFrame:
    """key, rep: a row for each band of each set that holds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, used = band_keys(np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(b.num_rows, BUCKETS))
                reps = np.repeat(b.column("rep").to_numpy(), used.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[used].view(np.int64)), pa.array(reps)], ["key", "rep"])

    return sets.select("rep", "regs").mapInArrow(lean(run), "key long, rep long")


def by_rare_shingles(sets: DataFrame, least: float) -> DataFrame:
    """key, rep of sets with a column few: each under its n - least * n + 1 rarest shingles (ties: the smaller hash).

    All sets rank shingles alike, so any two of likeness ``least`` share one of these.
    """
    own = sets.select("rep", "n", F.explode("few").alias("key"))
    counts = own.groupBy("key").agg(F.count("*").alias("_c"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("_c", "key"))
    keep = F.col("n") - F.ceil(least * F.col("n") - F.lit(1e-9)) + 1
    return own.join(counts, "key").withColumn("_place", place).filter(F.col("_place") <= keep).select("key", "rep")


def _counted(keyed: DataFrame) -> DataFrame:
    """``keyed`` with _c (the key's sets) and _head (the smallest of them), without keys that only one set has."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_c"), F.min("rep").alias("_head")).filter("_c > 1")
    return keyed.join(sizes, "key")


def meetings(sets: DataFrame, *, least: float, limit: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """key, rep of keys with 2 to ``limit`` sets; the links a > b of the stars of larger ones; and the tables that both read."""
    large = sets.filter(F.col("n") >= int(least * (TINY + 1)))
    banded_met = written(_counted(banded(large)), "bands", compact=False)
    tables = [banded_met]
    tiny_met = written(_counted(by_rare_shingles(sets.filter(F.col("n") <= TINY), least)), "shingles", compact=False)
    tables.append(tiny_met)
    kept, stars = [x.filter(F.col("_c") <= limit).select("key", "rep") for x in (banded_met, tiny_met)], [tiny_met.filter(F.col("_c") > limit)]
    hot = banded_met.filter(F.col("_c") > limit).select(F.col("key").alias("_first"), "rep")
    if not hot.isEmpty():
        second = hot.join(banded(large), "rep").filter("key <> _first").select(F.xxhash64("_first", "key").alias("key"), "rep")
        again = written(_counted(second), "second-bands", compact=False)
        tables.append(again)
        kept.append(again.filter(F.col("_c") <= limit).select("key", "rep"))
        stars.append(again.filter(F.col("_c") > limit))
    links = [s.filter("rep <> _head").select(F.col("rep").alias("a"), F.col("_head").alias("b")) for s in stars]
    some, ends = kept[0], links[0]
    for x in kept[1:]:
        some = some.union(x)
    for x in links[1:]:
        ends = ends.union(x)
    return some, ends, tables


def candidates(met: DataFrame, *, least: float, deviations: float | None) -> DataFrame:
    """a > b of rows key, rep, n, regs: links that connect, under each key, what all its candidates connect.

    What is connected under a key is a star around its smallest set, so keys of the same sets give the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, reps, n, words in sorted_groups(batches):
            regs = words.view(np.uint16).reshape(len(words), BUCKETS)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cut)
            size = np.repeat(sizes, sizes)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(1, min(SMALL, int(sizes.max()))):  # small keys, by how far apart two rows stand
                i = np.flatnonzero((keys[k:] == keys[:-k]) & (size[k:] <= SMALL))
                i = i[may_link(regs[i], regs[i + k], n[i], n[i + k], least, deviations)]
                a.append(reps[i])
                b.append(reps[i + k])
            for lo, m in zip(cut[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                rest, todo, head = np.arange(lo, lo + m), [], lo
                while len(rest):  # each row takes its candidates out of the rows that have none yet
                    if not todo:
                        head, todo, rest = rest[0], [rest[0]], rest[1:]
                    at = todo.pop()
                    near = may_link(regs[at], regs[rest], n[at], n[rest], least, deviations)
                    a.append(reps[rest[near]])
                    b.append(np.full(int(near.sum()), reps[head]))  # the smallest of what is connected
                    todo.extend(rest[near].tolist())
                    rest = rest[~near]
            pairs = _pairs(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return met.select("key", "rep", "n", "regs").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(lean(run), "a long, b long").distinct()


def _row_of(k: Column, h: Column) -> Column:
    return F.xxhash64(k, h)


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 2, least: float = 0.8, deviations: float | None = 6, limit: int = LIMIT) -> DataFrame:
    """A row a document: ``key``, n_shingles, component_id (the smallest key reachable over links), kept (its own).

    A-Z are lower-cased and words parted at blanks and \\t-\\r; a text with fewer words than a shingle is one shingle; one
    without words, empty or null, has an empty set and is linked with nothing, not even another such.  Rows are judged
    by their texts: rows with equal keys and other texts are other documents, equal rows share their fate (all of them are
    kept or none).  Null keys are larger than any other: they name a component (null) only where it has no other, and are
    then kept.  Texts are taken whole at any length; ties do not matter, as no link depends on an order.  An empty table
    gives no rows; columns with other names are not read.
    """
    whole = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("_k"), F.xxhash64(F.coalesce(whole, F.lit(""))).alias("_h"), whole.alias("_t"))
    prints = written(sketched(texts, shingle=shingle), "prints", compact=False)
    one = F.min(F.struct(F.col("_k").isNull().alias("none"), F.col("_k").alias("least"), "_h", "n", "regs", "few")).alias("r")
    sets = written(prints.filter("n > 0").groupBy("digest").agg(one).select("digest", "r.*").withColumn("rep", F.monotonically_increasing_id()), "classes", compact=False)
    classes = sets.select("digest", "rep", "least", "_h", "n")
    some, stars, met = meetings(sets.select("rep", "n", "regs", "few"), least=least, limit=limit)
    found = written(candidates(some.join(sets.select("rep", "n", "regs"), "rep"), least=least, deviations=deviations).union(stars), "candidates")
    discard(*met)
    clouds = components(found, name="clouds")
    members = classes.join(clouds, classes["rep"] == clouds["node"]).select("rep", F.col("component").alias("cloud"), "least", F.col("_h").alias("_mh"), "n")
    members = written(in_blocks(members), "members")
    # only texts that a bit map of fixed size shows meet the members in an exchange
    words = bit_words(members, _row_of(F.col("least"), F.col("_mh")))
    shown = may_be_in(texts, words, _row_of(F.col("_k"), F.col("_h")), "_may").filter("_may")
    linked = shown.join(members, shown["_k"].eqNullSafe(members["least"]) & (shown["_h"] == members["_mh"]))
    compared = written(gram_sets(linked, shingle, SEED), "sets", compact=False)
    links = written(verified_links(compared, least=least), "links")
    discard(compared, members, words, found, clouds)
    parts = components(links, stars=True)
    named = _named(classes, parts).select("digest", "component_id")
    out = prints.select("_k", "n", "digest").join(named, "digest", "left")
    # an empty set is a component of its own
    component = F.when(F.col("n") == 0, F.col("_k")).otherwise(F.col("component_id"))
    out = written(out.select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_k").eqNullSafe(component).alias("kept")), "hyper-minhash")
    discard(prints, sets, links, parts)
    return out

"""Near copies: texts whose sets of word shingles have a Jaccard likeness of ``least`` or more, without losing a link.

Candidates come first from SimHash: the deletion variants of ``simhash_near`` find all fingerprints (64 bits of the sketch)
two bits apart or less.  Two texts of likeness 0.8 differ in some ten of 64 bits, too many for variants, so the other
candidates come from rare shingles, which lose no link.  All candidates are compared exactly:

1. One pass counts the shingles of all documents in a table of fixed size (it can only count too much).
2. Texts with equal words are one class.  Of a text's n shingles the ``n - least * n + 1`` rarest are its keys: two texts
   of likeness ``least`` have one of them in common, as all texts rank shingles alike.
3. Keys that one text alone has go first, without sketches.  In a bucket of one key, texts may be linked whose sizes allow
   for it and whose ``BITS``-bit SimHashes are less than ``DEVIATIONS`` deviations farther apart than the likeness gives.
   A bucket sends a spanning forest of these links, never all pairs.  The components are clouds; no link leaves its cloud.
   The bits decide how large clouds become: with 128, one pair of strangers in forty that share a key passes, and clouds
   grow together as the corpus grows; with 256 one in ten million does.  Links by deletion variants join the buckets'.
4. Each cloud's sets of shingles meet once, in tasks of bounded size, and are compared exactly: by the same prefix rule with
   the counts of the cloud, and never within a component that has been found already.  A cloud that is too large for a task
   is cut into blocks, and every two blocks meet.  How many blocks a cloud has is known from its texts' sizes before any
   set is made, so sets are written once and exchanged once.
5. Components of the exact links are the groups of near copies.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bit_words, blocks, discard, flat, free_name, lean, may_be_in, mix64, runs, span_hashes, written
from .simhash_near import _distance, _named, _pairs, components, links, sorted_groups, star_links

#: Counters of shingles, in one table a task, and the pieces that they are sent in.
COUNTERS = 1 << 20
PIECES = 64
DEVIATIONS = 6
#: Bits that fingerprints of deletion variants may differ in.
RADIUS = 2
#: Bits of a sketch, and the 64-bit words that they are mixed from a hash with.
BITS = 256
MIXED = np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose shingles are hashed at once.
TEXT_BYTES = 1 << 19
#: Up to this size a bucket sends all its links.
SMALL = 4
#: Shingles that a task compares at once; larger clouds are cut into blocks of half as many.
CLOUD_SHINGLES = 4 << 20


def shingled(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingle hashes of each text, ascending, back to back; their offsets; and digests of the words.

    A-Z are lower-cased and words parted at blanks and \\t-\\r.  A text with fewer words than a shingle is one shingle.
    """
    data, offsets = flat(texts)
    low = LOWER[data]
    inside = ~SPACE[data]
    starts, ends = runs(inside, offsets)
    size = ends - starts
    word = np.repeat(np.arange(len(size)), size)
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)  # a blank behind every word
    joined[np.arange(len(word)) + word] = low[inside]
    begin = np.cumsum(size + 1) - size - 1
    first = np.searchsorted(starts, offsets)  # the first word of each text
    words = np.diff(first)
    count = np.maximum(words - shingle + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    head = first[:-1][doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    tail = head + np.minimum(words[doc], shingle) - 1
    h = span_hashes(joined, begin[head], begin[tail] + size[tail], seed)
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    raw = joined.tobytes()
    border = np.r_[begin, len(joined)][first].tolist()
    digests = [hashlib.md5(raw[a : max(a, b - 1)]).digest() for a, b in zip(border[:-1], border[1:], strict=True)]
    return h, np.searchsorted(doc, np.arange(len(words) + 1)), digests


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash of ``BITS`` bits of hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        x = hashes[at : at + (1 << 13)]
        bits = np.unpackbits(mix64(x[:, None] ^ MIXED).view(np.uint8).reshape(len(x), -1), axis=1)
        # eight counts a word: 255 rows at most, so none runs into the next one
        votes += np.add.reduceat(bits.view(np.uint64), np.arange(0, len(x), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def sketch_radius(least: float) -> int:
    """The distance of sketches that a likeness of ``least`` stays within by ``DEVIATIONS`` deviations (at least 0.5 a bit)."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(BITS * p + DEVIATIONS * np.sqrt(BITS * 0.25))


def least_common(n: np.ndarray | int, least: float) -> np.ndarray:
    """Number of shingles that any like text has in common with one of n shingles."""
    return np.ceil(least * np.asarray(n) - 1e-9).astype(np.int64)


def shingle_counts(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Documents by shingle, in ``COUNTERS`` counters of all documents; zero where a counter is within the noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for b in blocks(batches, "_t", TEXT_BYTES):
            h, _, _ = shingled(b.column("_t"), shingle, seed)
            found += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        pieces = np.minimum(found, 2**32 - 1).astype("<u4").reshape(PIECES, -1)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "counts": [x.tobytes() for x in pieces]})

    def total(table: pa.Table) -> pa.Table:
        found = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"piece": table.column("piece")[:1], "counts": [found.astype("<i8").tobytes()]})

    rows = written(texts.mapInArrow(lean(run), "piece int, counts binary").groupBy("piece").applyInArrow(total, "piece int, counts binary"), "counts")
    found = {r["piece"]: np.frombuffer(r["counts"], "<i8") for r in rows.collect()}  # COUNTERS numbers, however many documents
    discard(rows)
    if not found:
        return np.zeros(COUNTERS, np.int64)
    found = np.concatenate([found[k] for k in range(PIECES)])
    mean = found.mean()
    found[found <= mean + 8 * np.sqrt(mean) + 2] = 0
    return found


def prefixes(texts: DataFrame, counts: np.ndarray, *, shingle: int, least: float, seed: int) -> DataFrame:
    """For rows _k, _h, _t: _k, _h, digest (of the words), n (shingles), sketch and keys, the text's rarest shingles.

    Shingles are ranked by count and then by hash, in the same way for all texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in blocks(batches, "_t", TEXT_BYTES):
            h, offsets, digests = shingled(b.column("_t"), shingle, seed)
            n = np.diff(offsets)
            doc = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((h, counts[(h >> np.uint64(44)).astype(np.int64)], doc))
            use = np.arange(len(h)) - offsets[doc] < (n - least_common(n, least) + 1)[doc]
            keys = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[use], minlength=len(n)))]), pa.array(h[by][use].view(np.int64)))
            sketches = [sketch(h[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [b.column("_k"), b.column("_h"), pa.array(digests, pa.binary()), pa.array(n, pa.int32()), pa.array(sketches, pa.binary()), keys.cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_k", "_h", "digest", "n", "sketch", "keys"])

    return texts.mapInArrow(lean(run), "_k long, _h long, digest binary, n int, sketch binary, keys array<long>")


def print_links(prints: DataFrame) -> DataFrame:
    """a > b of rows rep, sketch: by deletion variants of the sketches' first 64 bits what is within ``RADIUS`` bits, where
    equal ones are a star."""
    fp = prints.select("rep", F.substring("sketch", 1, 8).alias("fp"))
    heads = fp.groupBy("fp").agg(F.min("rep").alias("head"))
    equal = fp.join(heads, "fp").filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    return links(heads.select(F.col("head").alias("rep"), "fp"), bits=64, radius=RADIUS).union(equal)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows key, rep whose key some other row has, too."""
    return keyed.select("key", "rep", F.count("*").over(Window.partitionBy("key")).alias("_m")).filter("_m > 1").drop("_m")


def candidate_links(keyed: DataFrame, *, least: float) -> DataFrame:
    """a > b of rows key, rep, n, sketch: for every bucket links that connect what all its possible links connect."""
    far = sketch_radius(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, reps, n, prints in sorted_groups(batches):
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(cut)
            size = np.repeat(sizes, sizes)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def fit(i, j):
                return (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (_distance(prints[i], prints[j]) <= far)

            for k in range(1, min(SMALL, int(sizes.max()))):
                i = np.flatnonzero((keys[k:] == keys[:-k]) & (size[k:] <= SMALL))
                i = i[fit(i, i + k)]
                a.append(reps[i])
                b.append(reps[i + k])
            for lo, m in zip(cut[:-1][sizes > SMALL], sizes[sizes > SMALL], strict=True):
                rest, todo = np.arange(lo, lo + m), []
                while len(rest):  # each row takes its links out of the rows that have none yet
                    if not todo:
                        todo, rest = [rest[0]], rest[1:]
                    at = todo.pop()
                    near = fit(at, rest)
                    a.append(reps[rest[near]])
                    b.append(np.full(int(near.sum()), reps[at]))
                    todo.extend(rest[near][::-1].tolist())
                    rest = rest[~near]
            pairs = _pairs(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return keyed.select("key", "rep", "n", "sketch").repartition("key").sortWithinPartitions("key", "rep").mapInArrow(lean(run), "a long, b long").distinct()


def exact_links(sets: list[np.ndarray], block: np.ndarray, across: bool, least: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that the pairs of likeness ``least`` connect; with ``across`` only between blocks.

    Every set's rarest elements are indexed, by their counts here.  A set meets those that share one of them, unless both
    are in one component by now, and the numbers of common elements are counted exactly.
    """
    n = np.array([len(x) for x in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    count = np.bincount(code)
    doc = np.repeat(np.arange(len(sets)), n)
    ends = np.cumsum(n)
    by = np.lexsort((code, count[code], doc))
    rare = np.arange(len(code)) - (ends - n)[doc] < (n - least_common(n, least) + 1)[doc]
    rare_code, rare_doc = code[by][rare], doc[rare]
    use = count[rare_code] > 1
    rare_code, rare_doc = rare_code[use], rare_doc[use]
    own = np.searchsorted(rare_doc, np.arange(len(sets) + 1))
    order = np.argsort(rare_code, kind="stable")
    posted, holders = rare_code[order], rare_doc[order]
    lo, hi = np.searchsorted(posted, rare_code), np.searchsorted(posted, rare_code, side="right")
    part, marked, links = np.arange(len(sets)), np.zeros(len(count), bool), []
    members = [np.array([i]) for i in range(len(sets))]
    for i in range(len(sets)):
        if own[i] == own[i + 1]:
            continue
        met = np.unique(np.concatenate([holders[lo[k] : hi[k]] for k in range(own[i], own[i + 1])]))
        met = met[(part[met] != part[i]) & (np.minimum(n[met], n[i]) >= least * np.maximum(n[met], n[i]) - 1e-9)]
        if across:
            met = met[block[met] != block[i]]
        if not len(met):
            continue
        marked[code[ends[i] - n[i] : ends[i]]] = True
        both = np.array([np.count_nonzero(marked[code[ends[j] - n[j] : ends[j]]]) for j in met.tolist()])
        marked[code[ends[i] - n[i] : ends[i]]] = False
        for j in met[both >= least * (n[met] + n[i] - both) - 1e-9].tolist():
            if part[j] != part[i]:
                to, gone = (part[i], part[j]) if len(members[part[i]]) >= len(members[part[j]]) else (part[j], part[i])
                part[members[gone]] = to  # the smaller part's rows change theirs
                members[to], members[gone] = np.concatenate([members[to], members[gone]]), None
                links.append((i, j))
    return links


def in_blocks(members: DataFrame) -> DataFrame:
    """``members`` (cloud, rep, n and others) with blocks, the number of blocks that the cloud's shingles make."""
    sizes = members.groupBy(F.col("cloud").alias("_c")).agg(F.sum(F.col("n").cast("long")).alias("_all"))
    blocked = members.join(sizes, F.col("cloud") == F.col("_c"))
    return blocked.withColumn("blocks", (F.ceil(F.col("_all") / F.lit(CLOUD_SHINGLES)) * 2).cast("int")).drop("_c", "_all")


def gram_sets(linked: DataFrame, shingle: int, seed: int) -> DataFrame:
    """cloud, blocks, rep and grams (ascending hashes of the shingles) of rows cloud, blocks, rep, _t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in blocks(batches, "_t", TEXT_BYTES):
            reps = b.column("rep").to_numpy()
            new = np.r_[last is None or reps[0] != last, reps[1:] != reps[:-1]]  # equal rows stand together
            b, last = b.filter(pa.array(new)), reps[-1]
            h, offsets, _ = shingled(b.column("_t"), shingle, seed)
            raw = h.tobytes()
            grams = [raw[8 * lo : 8 * hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cloud"), b.column("blocks"), b.column("rep"), pa.array(grams, pa.binary())], ["cloud", "blocks", "rep", "grams"])

    return linked.select("cloud", "blocks", "rep", "_t").mapInArrow(lean(run), "cloud long, blocks int, rep long, grams binary")


def verified_links(sets: DataFrame, *, least: float) -> DataFrame:
    """a > b of rows cloud, blocks, rep, grams (binary, ascending hashes): links that connect all near copies of a cloud,
    as stars where the cloud is one block.  Rows of one rep are one."""
    blocked = sets.withColumn("block", F.expr("if(blocks <= 2, 0, pmod(xxhash64(rep), blocks))").cast("int"))
    others = F.expr("if(blocks <= 2, array(0), sequence(0, blocks - 1))")
    pairs = blocked.withColumn("_other", F.explode(others)).select("cloud", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "rep", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = None, [], 0  # whole groups of one kind, up to the bound

        def found() -> pa.RecordBatch:
            reps, block = np.array([r[3] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
            links = exact_links([np.frombuffer(r[4], np.uint64) for r in held], block, held[0][0] != held[0][1], least)
            ends = reps[np.array(links, np.int64).reshape(-1, 2)]
            pairs = star_links(ends[:, 0], ends[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for cloud, lo, hi, block, rep, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and group != (cloud, lo, hi) and (lo != hi or group[1] != group[2] or size > CLOUD_SHINGLES // 4):
                    yield found()
                    held, size = [], 0
                if held and group == (cloud, lo, hi) and held[-1][3] == rep:
                    continue
                group = (cloud, lo, hi)
                held.append((lo, hi, block, rep, grams))
                size += len(grams) // 8
        if held:
            yield found()

    return pairs.repartition("cloud", "lo", "hi").sortWithinPartitions("cloud", "lo", "hi", "rep").select("cloud", "lo", "hi", "block", "rep", "grams").mapInArrow(lean(run), "a long, b long")


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """A row a document: ``key``, text_hash (XXH64 of the text), component_id (the smallest key of its group), stays.

    Rows are judged by their texts: rows with equal keys and other texts are other documents; rows that are equal in key
    and text are one.  Of a group the row with the smallest key stays (ties: one of the texts); a null key counts as the
    largest.  Null and empty texts and those without words are alike.  An empty table gives no rows.
    """
    spark, seed = docs.sparkSession, secrets.randbits(62) | 1
    texts = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_h"), F.col(text).cast("string").alias("_t"))
    counts = shingle_counts(texts.select("_t"), shingle, seed)
    prints = written(prefixes(texts, counts, shingle=shingle, least=least, seed=seed), "prints", compact=False)
    rows = written(prints.select("_k", "_h", "digest"), "rows")
    one = F.min(F.struct(F.col("_k").isNull().alias("none"), F.col("_k").alias("least"), "_h", "n", "sketch", "keys")).alias("r")
    full = written(prints.groupBy("digest").agg(one).select("digest", "r.*").withColumn("rep", F.monotonically_increasing_id()), "classes", compact=False)
    discard(prints)
    classes = written(full.select("digest", "rep", "least", "_h", "n"), "classes")
    prints = written(full.select("rep", "n", "sketch"), "sketches", compact=False)
    met = written(shared_keys(full.select("rep", F.explode("keys").alias("key"))), "met", compact=False)
    discard(full)
    near = written(print_links(prints), "print-links")
    found = written(candidate_links(met.join(prints, "rep"), least=least).union(near).distinct(), "candidates")
    discard(met, prints, near)
    clouds = components(found, name="clouds")
    members = classes.join(clouds, classes["rep"] == clouds["node"]).select("rep", F.col("component").alias("cloud"), "least", F.col("_h").alias("_mh"), "n")
    members = written(in_blocks(members), "members")

    # only texts that the bit map shows meet the members in an exchange
    words = bit_words(members, F.xxhash64("least", "_mh"))
    some = may_be_in(texts, words, F.xxhash64("_k", "_h"), "_may").filter("_may")
    linked = some.join(members, some["_k"].eqNullSafe(members["least"]) & (some["_h"] == members["_mh"]))
    sets = written(gram_sets(linked, shingle, seed), "sets", compact=False)
    kept = written(verified_links(sets, least=least), "links")
    discard(sets, members, words, found, clouds)
    parts = components(kept, stars=True)
    named = _named(classes, parts)
    heads = named.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "rep")).alias("_s")).select(F.col("component").alias("_c"), F.col("_s.rep").alias("_first"))
    fate = named.join(heads, F.col("component") == F.col("_c"), "left").select("digest", "component_id", F.col("least").alias("_own"), F.coalesce(F.col("rep") == F.col("_first"), F.lit(True)).alias("_head"))
    out = rows.join(fate, "digest").select(F.col("_k").alias(key), F.col("_h").alias("text_hash"), "component_id", (F.col("_head") & F.col("_k").eqNullSafe(F.col("_own"))).alias("stays"))
    out = written(out, "near-copies")
    discard(rows, classes, kept, parts)
    return out


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near copies (see ``near_copies``)."""
    fate = near_copies(docs, text=text, key=key, shingle=shingle, least=least)
    own, of_text, may = (free_name(n, docs.columns) for n in ("_own", "_of_text", "_may"))
    gone = fate.filter("not stays").select(F.col(key).alias(own), F.col("text_hash").alias(of_text)).distinct()
    k, h = F.col(f"`{key}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    # most rows surely stay by the bit map, and are not exchanged
    rows = may_be_in(docs, bit_words(gone, F.xxhash64(own, of_text)), F.xxhash64(k, h), may)
    left = rows.filter(F.col(may)).join(gone, k.eqNullSafe(F.col(own)) & (h == F.col(of_text)), "left_anti")
    return rows.filter(~F.col(may)).unionByName(left).drop(may)

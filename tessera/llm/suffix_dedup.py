"""Exact repeated passages: per-shard suffix arrays, and a merge of the shards by binary search.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller key.

* One range exchange by key brings documents in order; its tasks cut them into shards of some megabytes and write these
  once to the shared folder.  "A smaller key" in another shard means "a smaller shard".  All later passes read the shard
  files; what is exchanged from there on is hashes by hash range and bits by shard.
* Whole copies of an earlier document are found by digest, marked in their shard and never enter a suffix array.
* Anchors thin out the rest: of the ``GRAM``-byte grams of every window of ``length`` bytes the one with the smallest
  hash is selected, so equal windows select equal grams.  Shards send their sorted distinct anchors, by range of hash,
  and learn which ones another shard has too.  Windows around no such anchor can't repeat and are left alone.
* The suffixes that begin the remaining windows are sorted by Larsson-Sadakane refinement (only unsettled groups are
  sorted again, at doubled depth, until ``length`` bytes are settled); Kasai's common prefixes of neighbours give the
  classes of equal windows.  Each shard sends the sorted 64-bit digests of its classes; the merged run is met by
  binary search, and the answer is two bits a digest: whether a smaller shard has it, and whether any other has.
* Windows whose digests met are checked by a second, independent digest in the same way, and only what both rounds found
  goes.  The digests' base and byte codes are drawn anew for every run, so nobody can make texts that collide; among n
  windows n^3 / 2^128 are expected to be taken for equal wrongly (0.003 for 10^12 of them).

Tables between the passes and shard files lie in the shared folder, so a lost executor costs its tasks alone; all of
them are deleted when the result has been written.  Nothing is collected but the number of shards.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat, fresh_path, mix64, ranges_for, remove_path, span_hashes, store_of, written

#: Bytes of a gram, a multiple of eight: longer ones let fewer windows through, and select more anchors.
GRAM = 24
#: Bytes of text in a shard, and entries in a hash range: what one task holds at once.
SHARD_BYTES = 4 << 20
ANCHOR_BYTES = 1 << 19
RANGE_ENTRIES = 2_000_000
#: Shards that a task of a pass handles one after the other, where there are more than the session's partitions.
TASK_SHARDS = 8


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, big-endian, zero past the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] = (x[:-k] << np.uint64(8 * k)) | (x[k:] if k == 1 else x[k:])
    return x[: len(data)]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width], for every i with a whole window."""
    step = 1
    while 2 * step <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 48-bit hashes of the selected grams of all windows."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = _words8(data)
    h = mix64(w[: n - GRAM + 1])
    for k in range(8, GRAM, 8):
        h = mix64(h + w[k : n - GRAM + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    h |= np.uint64(1)
    low = _slide(h, width, np.minimum)  # of the window that starts here
    sizes = np.diff(offsets)
    whole = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - length + 1, -1)
    low[np.cumsum(whole)[: len(low)] == 0] = 0
    padded = np.zeros(len(h) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, width, np.maximum) == h)
    return at, mix64(h[at]) >> np.uint64(16)  # the selected hashes are small ones; mixed anew they spread evenly


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """``starts`` in the order of the ``length`` bytes from each on (all within ``data``), ties by position.

    Larsson-Sadakane: a rank is the place of its group's first member; only groups of two or more are sorted again.
    """
    n = len(data)
    key = _words8(data)
    order = np.argsort(key)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    depth = 8
    while 2 * depth <= length:
        tail = np.r_[head[1:], True]
        open_at = np.flatnonzero(~(head & tail))
        if not len(open_at):
            break
        sub = order[open_at]
        nxt = sub + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = (rank[sub].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        turn = np.argsort(pair)
        sub, pair = sub[turn], pair[turn]
        order[open_at] = sub
        head[open_at] = np.r_[True, pair[1:] != pair[:-1]]
        first = np.maximum.accumulate(np.where(head[open_at], np.arange(len(sub)), 0))
        rank[sub] = open_at[first]
        depth *= 2
    pair = (rank[starts].astype(np.uint64) << np.uint64(32)) | rank[starts + (length - depth)].astype(np.uint64)
    return starts[np.argsort(pair, kind="stable")]


def kasai(data: np.ndarray, starts: np.ndarray, ordered: np.ndarray, length: int, lane: int = 64) -> np.ndarray:
    """Common prefix, up to ``length``, of each suffix in ``ordered`` with the one before it (the first: 0).

    Kasai's rule in text order - one less than the last position's, then extended - runs in many lanes at once.  The rule
    needs the suffix after the last predecessor to be there too, and an order that is settled beyond the prefix (or that
    suffix as the new predecessor); where that fails, counting starts from 0.
    """
    m = len(starts)
    if not m:
        return np.zeros(0, np.int32)
    number = np.zeros(len(data), np.int32)
    number[starts] = np.arange(m, dtype=np.int32)
    ordered = number[ordered]
    before = np.empty(m, np.int32)
    before[ordered[1:]] = ordered[:-1]
    before[ordered[0]] = -1
    runs_on = np.r_[starts[1:] == starts[:-1] + 1, False]  # the next start is the next position
    out = np.zeros(m, np.int32)
    begin = np.arange(0, m, lane)
    for t in range(lane):
        i = begin[begin + t < m] + t
        h = np.zeros(len(i), np.int32)
        if t:
            j = before[i - 1]
            carry = (j >= 0) & runs_on[i - 1] & runs_on[np.maximum(j, 0)] & ((out[i - 1] < length) | (before[i] == j + 1))
            h = np.where(carry, np.maximum(out[i - 1] - 1, 0), 0).astype(np.int32)
        p = before[i]
        live = np.flatnonzero((p >= 0) & (h < length))
        while len(live):
            same = data[starts[i[live]] + h[live]] == data[starts[p[live]] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < length]
        out[i] = h
    return out[ordered]


def _pack(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers as byte planes: the high planes are nearly constant and compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _shard_writer(folder: str, shard_bytes: int):
    """For sorted rows _k, _kind (0: a copy's digest _d, 1: a text _t): writes shard files, yields shard, ord, path, size.

    A shard ends at the first new key after ``shard_bytes``; a key that holds more than that goes on in shards of its own,
    which all have the ``ord`` of the first of them, as they don't take from each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        keys, texts, copies, size = [], [], [], 0
        number, order, marked, last = first, first, set(), ()

        def shard() -> pa.RecordBatch:
            store, root = store_of(folder)
            store.create_dir(root, recursive=True)
            name = f"{number:016x}-{uuid.uuid4().hex[:8]}"
            columns = {"key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.large_binary()), "copy": pa.array(copies, pa.bool_())}
            table = pa.table(columns)
            with store.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            return pa.RecordBatch.from_pydict({"shard": [number], "ord": [order], "path": [f"{folder}/{name}"], "size": [size]})

        for batch in batches:
            for k, kind, t, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last != (k,):
                    if size >= shard_bytes:
                        yield shard()
                        keys, texts, copies, size = [], [], [], 0
                        number += 1
                    if not keys:
                        order = number
                    marked, last = set(), (k,)
                elif size >= shard_bytes and keys[0] == k:  # this key alone
                    yield shard()
                    keys, texts, copies, size = [], [], [], 0
                    number += 1
                if kind:
                    t = t.encode("utf-8", "surrogatepass")
                    keys.append(k)
                    texts.append(t)
                    copies.append(bool(marked) and hashlib.md5(t).digest() in marked)
                    size += len(t)
                else:
                    marked.add(d)
        if keys:
            yield shard()

    return run


def _bits(rows: list[dict], kind: int, name: str) -> np.ndarray:
    found = [np.unpackbits(np.frombuffer(r[name], np.uint8))[: r["n"]] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])]
    return np.concatenate(found).astype(bool) if found else np.zeros(0, bool)


class Shard:
    """The documents of one shard, in blocks of bytes, and what other shards have answered."""

    def __init__(self, manifest: pa.Table, answers: pa.Table, length: int):
        row, rows = manifest.to_pylist()[0], answers.to_pylist()
        self.number, self.order, self.length, self.rows = row["shard"], row["ord"], length, rows
        store, path = store_of(row["path"])
        with store.open_input_stream(path) as f:
            docs = pa.ipc.open_stream(f).read_all().combine_chunks()
        self.key = docs.column("key").combine_chunks()
        known, filled = pc.is_valid(self.key).to_numpy(zero_copy_only=False), pc.fill_null(self.key, 0).to_numpy()
        # the rank of a document's key in the shard
        self.keys = np.cumsum(np.r_[False, (filled[1:] != filled[:-1]) | (known[1:] != known[:-1])])
        text = docs.column("text").combine_chunks()
        self.data, self.offsets = flat(text)
        self.copy = docs.column("copy").to_numpy(zero_copy_only=False).astype(bool)
        self.shared = _bits(rows, 1, "many")
        # the copies' texts are cut out, so that nothing below sees them
        own = ~self.copy
        sizes = np.diff(self.offsets)
        self.kept = np.flatnonzero(own)
        self.text = self.data[np.repeat(own, sizes)] if self.copy.any() else self.data
        self.at = np.r_[0, np.cumsum(sizes[own])]

    def save(self, candidate: np.ndarray, hit: np.ndarray, folder: str) -> str:
        """Keep the candidates and the hits within the shard for the later passes."""
        path = f"{folder}/{self.number:016x}-{uuid.uuid4().hex[:8]}-state"
        store, at = store_of(path)
        with store.open_output_stream(at) as f:
            f.write(len(candidate).to_bytes(8, "little") + candidate.astype("<i8").tobytes() + np.packbits(hit).tobytes())
        return path

    def load(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Starts of the candidate windows, their bytes, the starts' places in these, and hits so far; None without any."""
        path = next((r["bits"].decode() for r in self.rows if r["kind"] == 0), None)
        if path is None:
            return None
        store, at = store_of(path)
        with store.open_input_stream(at) as f:
            state = f.read()
        if not (runs := int.from_bytes(state[:8], "little")):
            return None
        starts, small, at = self.spread(np.frombuffer(state, "<i8", 2 * runs, 8).reshape(-1, 2))
        return starts, small, at, np.unpackbits(np.frombuffer(state, np.uint8, offset=8 + 16 * runs))[: len(starts)].astype(bool)

    def met(self, hit: np.ndarray, small: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all starts: a smaller shard has its first digest; any other shard has."""
        less, many = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
        free = np.flatnonzero(~hit)
        by = free[np.argsort(self.digests(small, at[free], seed), kind="stable")]
        less[by], many[by] = _bits(self.rows, 2, "bits"), _bits(self.rows, 2, "many")
        return less, many

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        found, lo = [], 0
        while lo < len(self.kept):
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + ANCHOR_BYTES, side="right")) - 1)
            p, h = anchors(self.text[self.at[lo] : self.at[hi]], self.at[lo : hi + 1] - self.at[lo], self.length)
            found.append((p + self.at[lo], h))
            lo = hi
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])

    def candidates(self) -> np.ndarray:
        """Runs of window starts that may repeat, as rows (first, last), in order."""
        p, h = self.anchors()
        doc = np.searchsorted(self.at, p, side="right") - 1
        distinct, code = np.unique(h, return_inverse=True)
        key = self.keys[self.kept][doc]
        by = np.lexsort((key, code))  # also in another document of this shard
        shared = np.zeros(len(distinct), bool)
        shared[code[by[1:]][(code[by[1:]] == code[by[:-1]]) & (key[by[1:]] != key[by[:-1]])]] = True
        if len(self.shared):
            shared |= self.shared
        use = shared[code]
        p, doc = p[use], doc[use]
        lo, hi = np.maximum(self.at[doc], p - (self.length - GRAM)), np.minimum(p, self.at[doc + 1] - self.length)
        lo, hi = lo[hi >= lo], hi[hi >= lo]
        if not len(lo):
            return np.zeros((0, 2), np.int64)
        new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + 1])
        return np.stack([lo[new], hi[np.r_[new[1:], len(hi)] - 1]], 1)

    def spread(self, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts of the runs, the bytes of their windows alone, and the starts' places in these."""
        lo, hi = candidate.T
        size = hi - lo + 1
        starts = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1] + self.length])
        begin, end = lo[new], hi[np.r_[new[1:], len(hi)] - 1] + self.length
        small = np.concatenate([self.text[a:b] for a, b in zip(begin, end, strict=True)])
        shift = begin - np.r_[0, np.cumsum(end - begin)[:-1]]
        return starts, small, starts - np.repeat(shift[np.searchsorted(begin, lo, side="right") - 1], size)

    def local(self, candidate: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Which starts (in text order) repeat a smaller document of this shard, and the sorted digests of the others."""
        length = self.length
        if not len(candidate):
            return np.zeros(0, bool), np.zeros(0, np.uint64)
        starts, small, at = self.spread(candidate)
        ordered = sort_suffixes(small, at, length)
        head = kasai(small, at, ordered, length) < length
        number = np.zeros(len(small), np.int32)
        number[at] = np.arange(len(at), dtype=np.int32)
        ordered = number[ordered]
        key = self.keys[self.kept][np.repeat(np.searchsorted(self.at, candidate[:, 0], side="right") - 1, candidate[:, 1] - candidate[:, 0] + 1)]
        # a run of candidates lies in one document; classes are groups of neighbours in suffix order
        first = np.flatnonzero(head)
        least = np.minimum.reduceat(key[ordered], first)
        hit = np.zeros(len(starts), bool)
        hit[ordered] = key[ordered] > np.repeat(least, np.diff(np.r_[first, len(ordered)]))
        return hit, np.sort(self.digests(small, at[~hit], seed))

    def digests(self, small: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
        """Digests of the windows that start at the places ``at`` (ascending) of ``small``."""
        out = np.empty(len(at), np.uint64)
        step = 1 << 19
        for lo in range(0, len(at), step):  # blocks of starts; their windows lie in a block of bytes
            x = at[lo : lo + step]
            base, top = int(x[0]), int(x[-1]) + self.length
            out[lo : lo + step] = span_hashes(small[base:top], x - base, x - base + self.length, seed)
        return out


def _parts(values: np.ndarray, parts: int, top: int) -> np.ndarray:
    """Range number of each sorted value below 2^top, monotone in the value."""
    return ((values >> np.uint64(top - 32)) * np.uint64(parts)) >> np.uint64(32)


def _sent(values: np.ndarray, shard: int, order: int, parts: int, top: int) -> pa.Table:
    part = _parts(values, parts, top)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(values) else np.zeros(1, np.int64)
    of = lambda x: pa.array(np.full(len(cut) - 1, x, np.int64))
    return pa.table({"part": pa.array(part[cut[:-1]].astype(np.int64)), "shard": of(shard), "ord": of(order), "run": pa.array([_pack(values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


_SENT = "part long, shard long, ord long, run binary"
_ANSWER = "shard long, kind int, part long, n long, bits binary, many binary"


def _answering(kind: int):
    return lambda table: _answered(table, kind)


def _answered(table: pa.Table, kind: int) -> pa.Table:
    """Merge the shards' sorted runs of one hash range; each run then meets the merged one by binary search.

    A part below zero is the path of a shard's own state, which is handed on as it is.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["ord"], r["shard"]))
    if rows[0]["part"] < 0:
        none = pa.nulls(len(rows), pa.binary())
        return pa.table({"shard": [r["shard"] for r in rows], "kind": pa.array([0] * len(rows), pa.int32()), "part": [0] * len(rows), "n": [0] * len(rows), "bits": pa.array([r["run"] for r in rows], pa.binary()), "many": none})
    runs = [_unpack(r["run"]) for r in rows]
    every = np.concatenate(runs)
    orders = np.unique(np.array([r["ord"] for r in rows], np.int64))
    place = np.searchsorted(orders, [r["ord"] for r in rows]).astype(np.int32)
    order = np.repeat(place, [len(x) for x in runs])
    by = np.argsort(every, kind="stable")  # orders ascend within a value
    every, order = every[by], order[by]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    merged, smallest = every[first], order[first]
    several = order[np.r_[first[1:], len(every)] - 1] != smallest
    bits, many = [], []
    for own, x in zip(place, runs, strict=True):
        at = np.searchsorted(merged, x)
        bits.append(np.packbits(smallest[at] < own).tobytes())
        many.append(np.packbits(several[at]).tobytes())
    return pa.table({"shard": [r["shard"] for r in rows], "kind": pa.array([kind] * len(rows), pa.int32()), "part": [r["part"] for r in rows], "n": [len(x) for x in runs], "bits": pa.array(bits, pa.binary()), "many": pa.array(many, pa.binary())})


def repeated_bytes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a document: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).

    Texts are taken as UTF-8, null as empty; texts shorter than ``length`` keep all.  A null key counts as smaller than
    any other; rows with equal keys don't take from each other; an empty table gives no rows; other columns are ignored,
    whatever their names.  A text that is longer than a shard is a shard of its own.
    """
    spark = docs.sparkSession
    seeds = (secrets.randbits(62) | 1, secrets.randbits(62) | 1)
    folder = fresh_path(spark, "shards")
    use = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    digests = use.filter(F.octet_length("_t") >= length).select("_k", F.md5("_t").alias("d"))
    rank = F.struct(F.col("_k").isNotNull().alias("known"), F.col("_k").alias("k"))
    firsts = written(digests.groupBy("d").agg(F.min(rank).alias("f"), F.count("*").alias("c")).filter("c > 1").select("d", "f"), "firsts")
    copies = written(digests.join(firsts, "d").filter(rank > F.col("f")).select("_k", F.unhex("d").alias("_d")).distinct(), "copies")
    rows = use.select("_k", F.lit(1).alias("_kind"), "_t", F.lit(None).cast("binary").alias("_d")).unionByName(copies.select("_k", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_t"), "_d"))
    ranged = rows.repartitionByRange(ranges_for(use), "_k").sortWithinPartitions("_k", "_kind")
    shards = written(ranged.mapInArrow(_shard_writer(folder, shard_bytes), "shard long, ord long, path string, size long"), "shard-list")
    told = shards.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    ranges = int((told["bytes"] or 0) // (RANGE_ENTRIES * 8)) + 1
    tasks = max(1, min(told["n"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), told["n"] // TASK_SHARDS)))
    listed = shards.repartition(tasks, "shard").groupBy("shard")

    def with_answers(answers: DataFrame, step, schema: str) -> DataFrame:
        """The step for every shard and its answers; both are dealt by shard, and AQE doesn't merge the tasks."""
        return listed.cogroup(answers.repartition(tasks, "shard").groupBy("shard")).applyInArrow(step, schema)

    def send_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left, right, length)
        return _sent(np.unique(s.anchors()[1]), s.number, s.order, ranges, 48)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left, right, length)
        candidate = s.candidates()
        hit, digest = s.local(candidate, seeds[0])
        own = pa.table({"part": [-1 - s.number], "shard": [s.number], "ord": [s.order], "run": pa.array([s.save(candidate, hit, folder).encode()], pa.binary())})
        return pa.concat_tables([_sent(digest, s.number, s.order, ranges, 64), own])

    def send_checks(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left, right, length)
        digest = np.zeros(0, np.uint64)
        if found := s.load():
            _, small, at, hit = found
            digest = np.sort(s.digests(small, at[s.met(hit, small, at, seeds[0])[1]], seeds[1]))
        return _sent(digest, s.number, s.order, ranges, 64)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left, right, length)
        gone = np.zeros(len(s.text), bool)
        if found := s.load():
            starts, small, at, hit = found
            less, many = s.met(hit, small, at, seeds[0])
            again = np.flatnonzero(many)
            sure = np.zeros(len(hit), bool)
            sure[again[np.argsort(s.digests(small, at[again], seeds[1]), kind="stable")]] = _bits(s.rows, 3, "bits")
            starts = starts[hit | less & sure]
            if len(starts):
                new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
                for a, b in zip(starts[new], starts[np.r_[new[1:], len(starts)] - 1] + length, strict=True):
                    gone[a:b] = True
        n = len(s.keys)
        size = np.diff(s.offsets)
        removed, spans = np.where(s.copy, size, 0), s.copy.astype(np.int64)
        empty = hashlib.sha256().hexdigest()
        digests = [empty] * n
        for i, d in enumerate(s.kept):
            lo, hi = s.at[i], s.at[i + 1]
            g = gone[lo:hi]
            removed[d] = k = int(g.sum())
            spans[d] = int((g[1:] & ~g[:-1]).sum() + g[0]) if k else 0
            digests[d] = hashlib.sha256((s.text[lo:hi][~g] if k else s.text[lo:hi]).tobytes()).hexdigest()
        return pa.table({"_k": s.key, "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests, pa.string())})

    known = written(spark.createDataFrame([], _ANSWER), "none")
    tables = [firsts, copies, shards, known]
    for kind, step, name in ((1, send_anchors, "anchors"), (2, send_windows, "windows"), (3, send_checks, "checks")):
        answers = written(with_answers(known, step, _SENT).groupBy("part").applyInArrow(_answering(kind), _ANSWER), name)
        tables.append(answers)
        known = known.unionAll(answers) if kind > 2 else answers  # windows carry the state on; anchors are done with
    out = written(with_answers(known, finish, "_k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_k", key), "repeated")
    discard(*tables)
    remove_path(spark, folder)
    return out

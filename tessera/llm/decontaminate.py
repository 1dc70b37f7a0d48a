"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set that meets all documents, in blocks of items with a checked size; no text of the
corpus is shuffled.  One scan counts each item n-gram in the whole corpus; an item's rarer n-grams become its seeds.  A
second scan finds seeds in every whole document, gathers them by item and diagonal into windows, and aligns each window
with the item word by word (match 2, other word -1, gap -1).  The best score over the perfect score 2 * words is the
similarity, which edits and paraphrase lower gradually, while chance agreement of common words stays far below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, blocks, flat, free_name, lean, mix64, runs, span_hashes

#: Items are broadcast in blocks of at most this many bytes of text.
ITEM_BYTES = 16 << 20
_SLOTS = 22  # log2 of the size of the table that rules most positions out

SCHEMA = "doc_id long, item_id long, score double, start long, end long"


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words of all texts, each text's first word, and the texts' offsets.

    Words are runs of letters and digits; letters of ASCII and Latin-1 in either case are alike.
    """
    data, offsets = flat(texts)
    low = LOWER[data]
    if len(low) > 1:  # UTF-8 of U+00C0 to U+00DE, without the multiplication sign
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][second] += 0x20
    starts, ends = runs(ALNUM[low], offsets)
    return span_hashes(low, starts, ends), starts, ends, np.searchsorted(starts, offsets), offsets


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each position (fewer positions by n - 1), and whether it lies within one text."""
    size = max(0, len(hashes) - n + 1)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(size, np.uint64)
    for k in range(n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
    inside = np.ones(size, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        inside[at[(at >= 0) & (at < size)]] = False
    return mix64(g), inside


class Items:
    """A block of items: word hashes, and their n-grams sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        h, _, _, first, _ = words(pa.array(texts, pa.large_string()))
        self.ids, self.n = ids, n
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        g, item, at = [], [], []
        for i, w in enumerate(self.words):
            k = min(n, len(w))
            if k:  # an item with fewer words than n is one gram, found by its first words
                x, _ = ngrams(w, np.array([0, len(w)]), k)
                g.append(x)
                item.append(np.full(len(x), i))
                at.append(np.arange(len(x)))
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < n})
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self._set(cat(g, np.uint64), cat(item, np.int64), cat(at, np.int64))

    def _set(self, grams: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.at = grams[order], item[order], at[order]
        self.table = np.zeros(1 << _SLOTS, bool)
        self.table[(self.grams >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of all texts at which an n-gram of an item begins, and the place of its hash in ``grams``."""
        out = []
        for n in (self.n, *self.short):
            g, inside = ngrams(hashes, first, n)
            at = np.flatnonzero(inside & self.table[(g >> np.uint64(64 - _SLOTS)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
            lo = np.searchsorted(self.grams, g[at])
            same = lo < len(self.grams)
            same[same] = self.grams[lo[same]] == g[at][same]
            out.append((at[same], lo[same]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def keep_rare(self, counts: np.ndarray, share: float, least: int) -> None:
        """Of each item keep the rarest ``share`` of its n-grams, ``least`` at least; ``counts`` is by place in ``grams``."""
        order = np.lexsort((self.at, counts, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        size = np.bincount(item, minlength=len(self.words))[item]
        keep = order[rank < np.maximum(least, np.ceil(size * share))]
        self._set(self.grams[keep], self.item[keep], self.at[keep])
        self.seeds = np.bincount(self.item, minlength=len(self.words))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (match 2, mismatch -1, gap -1) and the end of the text's aligned part (exclusive)."""
    n = len(text)
    row, best, end = np.zeros(n + 1, np.int32), 0, 0
    slope = np.arange(n + 1, dtype=np.int32)
    for w in item:
        new = np.zeros(n + 1, np.int32)
        new[1:] = np.maximum(row[:-1] + np.where(text == w, 2, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope) - slope  # gaps along the text
        top = int(new.argmax())
        if new[top] > best:
            best, end = int(new[top]), top
        row = new
    return best, end


def _windows(doc_at: np.ndarray, item_at: np.ndarray, m: int, size: int) -> list[tuple[int, int, int]]:
    """Windows of the text around the hits' diagonals, and the number of different item positions hit in each."""
    slack = m // 2 + 4
    lo = np.maximum(0, doc_at - item_at - slack)
    order = np.argsort(lo, kind="stable")
    lo, hi, at = lo[order], np.minimum(size, lo[order] + m + 2 * slack), item_at[order]
    cut = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1]])
    return [(int(lo[a]), int(hi[a:b].max()), len(np.unique(at[a:b]))) for a, b in zip(cut, np.r_[cut[1:], len(lo)], strict=True)]


def _leaks(b: pa.RecordBatch, items: Items, min_score: float, hits: int, text: str = "_t") -> list[tuple]:
    h, starts, ends, first, offsets = words(b.column(text))
    pos, place = items.find(h, first)
    if not len(pos):
        return []
    # a hash may belong to several items: every place with it counts
    n_same = np.searchsorted(items.grams, items.grams[place], side="right") - place
    pos = np.repeat(pos, n_same)
    place = np.repeat(place, n_same) + np.arange(len(pos)) - np.repeat(np.cumsum(n_same) - n_same, n_same)
    doc = np.searchsorted(first, pos, side="right") - 1
    item = items.item[place]
    order = np.lexsort((pos, item, doc))
    doc, item, pos, at = doc[order], item[order], pos[order], items.at[place][order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), True])
    out, data = [], None
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        d, i = int(doc[a]), int(item[a])
        w, base = items.words[i], int(first[d])
        best = (0, 0, 0)
        for lo, hi, met in _windows(pos[a:z] - base, at[a:z], len(w), int(first[d + 1]) - base):
            if met < min(hits, int(items.seeds[i])):
                continue
            score, end = align(w, h[base + lo : base + hi])
            if score > best[0]:
                best = (score, lo, lo + end)
        score = best[0] / (2 * len(w))
        if score >= min_score:
            lo, end = best[1], best[2]
            _, back = align(w[::-1], h[base + lo : base + end][::-1])
            if data is None:
                data = flat(b.column(text))[0]
            from_byte, to_byte = starts[base + end - back], ends[base + end - 1]
            count = lambda x, y: int(((data[x:y] & 0xC0) != 0x80).sum())
            start = count(offsets[d], from_byte)
            out.append((d, items.ids[i], score, start, start + count(from_byte, to_byte)))
    return out


def _seeded(texts: DataFrame, items: Items, share: float, least: int) -> Items:
    """Count the items' n-grams over all ``texts`` (column _t) and keep each item's rarest."""
    given = texts.sparkSession.sparkContext.broadcast(items)  # at most ITEM_BYTES of text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(given.value.grams), np.int64)
        for b in blocks(batches, "_t"):
            h, _, _, first, _ = words(b.column("_t"))
            total += np.bincount(given.value.find(h, first)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    counts = np.zeros(len(items.grams), np.int64)
    if len(counts):
        for r in texts.select("_t").mapInArrow(lean(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most the items' n-grams
            counts[r["place"]] = r["n"]
    items.keep_rare(counts, share, least)
    return items


def item_blocks(texts: DataFrame, benchmark: DataFrame, *, item: str = "item_id", item_text: str = "text", n: int = 3, share: float = 0.7, least: int = 8) -> Iterator[Items]:
    """The items with their seeds, in blocks of ITEM_BYTES of text (a longer item is a block of its own).

    Equal rows are one item.  Blocks are dealt by hash, and their size is checked: what exceeds it is cut further.
    """
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null").distinct()
    parts = int((rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // ITEM_BYTES) + 1
    for k in range(parts):
        ids, held, size = [], [], 0
        for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").toLocalIterator():
            bytes_of = len((r["t"]).encode("utf-8", "surrogatepass"))
            if ids and size + bytes_of > ITEM_BYTES:
                yield _seeded(texts, Items(ids, held, n), share, least)
                ids, held, size = [], [], 0
            ids.append(r["i"])
            held.append(r["t"])
            size += bytes_of
        if ids:
            yield _seeded(texts, Items(ids, held, n), share, least)


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", min_score: float = 0.5, hits: int = 2, **options) -> DataFrame:
    """A row for each document and item whose alignment reaches ``min_score``: doc_id, item_id, score, start, end.

    ``start`` and ``end`` bound the best aligned part in code points.  A window is aligned with ``hits`` different seeds
    (one, if the item has one); with ``hits=1, share=1.0`` every window that has any n-gram of an item is.  Items and
    documents without words match nothing, nulls are empty, repeated rows give repeated answers, empty tables give no rows,
    and further columns are ignored.  Texts are scanned whole, a very long one as a block of its own, of which only the
    windows around seeds are aligned.
    """
    spark = docs.sparkSession
    use = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t"))
    found = []
    for items in item_blocks(use, benchmark, **options):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, "_t"):
                if got := _leaks(b, shared.value, min_score, hits):
                    d, i, score, lo, hi = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("_k").take(pa.array(d)), pa.array(i, pa.int64()), pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "item_id", "score", "start", "end"])

        found.append(use.mapInArrow(lean(scan), SCHEMA))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", min_score: float = 0.5, hits: int = 2, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a leak (see ``leaks``).

    A row's fate hangs on its own text, so it is dropped where it is scanned: no exchange, and keys may be null or repeat.
    """
    spark, names, t = docs.sparkSession, docs.columns, free_name("_t", docs.columns)
    given = docs.select("*", F.col(f"`{text}`").cast("string").alias(t))
    for items in item_blocks(given.select(F.col(t).alias("_t")), benchmark, **options):
        shared = spark.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, t):
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in _leaks(b, shared.value, min_score, hits, t)]] = False
                yield b.filter(pa.array(clean))

        given = given.mapInArrow(lean(keep), given.schema)
    return given.select(*[F.col(f"`{c}`") for c in names])

"""Secret scans with a linear-chain conditional random field.

Exact base patterns come first (assignments, access keys, long hex strings).  Then a CRF tags every token of every text
as O, B or I from its shape, its neighbours' shapes, the gaps and key words beside it, and features of the file; Viterbi
decodes, and tagged runs outside the base spans are added.

The CRF is fitted on the driver on a bounded sample: windows around the base spans of at most ``sample`` documents that
hold likely words and as many documents at large, both in the order of a hash of the key.  Every positive window is also
shown without its key word and assignment, as it is and with other lengths and alphabets, so that shape alone carries it.

Decoding is exact and vectorized: a token whose O score exceeds the others by more than any two transitions can give
back is O on the best path, so chains fall apart into short islands, which Viterbi then decodes in batches by length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_class, flat, lean, runs

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns; letters of the first in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_KEY_WORDS = re.compile(rb"passw(?:or)?d|pwd|secret|token|api_?key|credential|bearer|private_?key|access_?key")

_TOKEN = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-" + bytes(range(128, 256)))
_SHAPE = np.zeros(256, np.uint8)
for _chars, _bit in ((b"abcdef", 1), (b"ghijklmnopqrstuvwxyz", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), (b"0123456789", 8), (b"+/_-", 16), (bytes(range(128, 256)), 32)):
    _SHAPE[list(_chars)] = _bit
_COARSE = np.where(_SHAPE <= 2, np.minimum(_SHAPE, 1), _SHAPE)  # letters of both halves alike
_GAP = np.full(256, 8, np.uint8)
_GAP[_TOKEN] = 0
for _chars, _bit in ((b"\n\r", 1), (b":=", 2), (b"\"'`", 4), (b" \t", 16)):
    _GAP[list(_chars)] = _bit
_DIGIT = byte_class(b"0123456789")
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 32, 40, 48, 64])

#: The number of values of each feature.
SIZES = (15, 64, 25, 32, 32, 3, 64, 64, 16, 960)
_AT = np.cumsum((0, *SIZES[:-1]))
_KEY_FEATURE = 5


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base matches; the span is the whole match."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' starts, ends and documents, and their feature codes (tokens x features, offset into one weight table)."""
    starts, ends = runs(_TOKEN[data], offsets)
    n = len(starts)
    codes = np.zeros((n, len(SIZES)), np.int32)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not n:
        return starts, ends, doc, codes
    shape = np.bitwise_or.reduceat(_SHAPE[data], starts)
    digits = np.add.reduceat(_DIGIT[data].astype(np.int32), starts)
    coarse = _COARSE[data]
    change = np.zeros(len(data), np.int32)
    change[1:] = (coarse[1:] != coarse[:-1]) & (coarse[1:] > 0) & (coarse[:-1] > 0)
    change[starts] = 0
    changes = np.add.reduceat(change, starts)
    length = ends - starts
    bucket = np.searchsorted(_LENGTHS, length, side="right")
    gaps = np.r_[_GAP[data], np.uint8(1)]
    gap = np.bitwise_or.reduceat(gaps, ends)
    first = np.r_[True, doc[1:] != doc[:-1]]
    last = np.r_[first[1:], True]
    gap = np.where(last, 1, gap)
    before = np.r_[np.uint8(1), gap[:-1]]
    # documents are parted by a byte that no key word has, so none is read over a border
    raw, border = bytes(data).lower(), offsets.tolist()
    low = b"\n".join(raw[a:b] for a, b in zip(border[:-1], border[1:], strict=True))
    found = np.fromiter((m.start() for m in _KEY_WORDS.finditer(low)), np.int64)
    found -= np.searchsorted(offsets + np.arange(len(offsets)), found, side="right") - 1
    at = np.searchsorted(starts, found, side="right") - 1
    key = np.zeros(n + 2, bool)
    key[at[at >= 0]] = True
    key = key[:n]
    one = np.r_[False, key[:-1]] & ~first
    two = np.r_[False, one[:-1]] & ~first
    size = np.diff(offsets)
    per_doc = np.bincount(doc, digits, len(size)) / np.maximum(1, size)
    has_key = np.bincount(doc, key, len(size)) > 0
    lines = np.bincount(doc, gap & 1, len(size)) > 8
    file = (np.searchsorted([0.005, 0.02, 0.08], per_doc) * 4 + has_key * 2 + lines).astype(np.int32)
    codes[:, 0] = bucket
    codes[:, 1] = shape
    codes[:, 2] = np.ceil(4 * digits / length).astype(np.int32) * 5 + np.searchsorted([1, 2, 3, 6], changes, side="right")
    codes[:, 3] = before
    codes[:, 4] = gap
    codes[:, 5] = np.where(one, 1, np.where(two, 2, 0))
    codes[:, 6] = np.where(first, 0, np.r_[np.uint8(0), shape[:-1]])
    codes[:, 7] = np.where(last, 0, np.r_[shape[1:], np.uint8(0)])
    codes[:, 8] = file[doc]
    codes[:, 9] = bucket * 64 + shape
    return starts, ends, doc, codes + _AT.astype(np.int32)


def fit(codes: np.ndarray, labels: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 3) and transitions (3 x 3) of the CRF from windows: codes (n, L, f), labels (n, L) in O, B, I.

    Tokens with equal features are scored and counted once.  Forward and backward sums are scaled at every step, so they
    stay products of small matrices.
    """
    n, length, f = codes.shape
    kinds, kind = np.unique(codes.reshape(-1, f), axis=0, return_inverse=True)
    kind = kind.reshape(n, length)
    w, t = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    gold_w, gold_t = np.zeros_like(w), np.zeros_like(t)
    for y in range(3):
        gold_w[:, y] = np.bincount(codes[labels == y].ravel(), minlength=len(w))
    np.add.at(gold_t, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    steps = np.ascontiguousarray(kind.T)
    for _ in range(rounds):
        score = w[kinds].sum(1)
        emit = np.exp(score - score.max(1, keepdims=True))[steps]  # (L, n, 3)
        move = np.exp(t)
        ahead, behind, scale = np.empty_like(emit), np.ones_like(emit), np.empty((length, n, 1))
        for i in range(length):
            x = emit[i] if not i else (ahead[i - 1] @ move) * emit[i]
            scale[i] = x.sum(1, keepdims=True)
            ahead[i] = x / scale[i]
        for i in range(length - 2, -1, -1):
            behind[i] = ((behind[i + 1] * emit[i + 1]) @ move.T) / scale[i + 1]
        p = ahead * behind
        after = (emit * behind / scale)[1:].reshape(-1, 3)
        pair = (ahead[:-1].reshape(-1, 3).T @ after) * move
        share = np.stack([np.bincount(steps.ravel(), p[:, :, y].ravel(), len(kinds)) for y in range(3)], 1)
        have = np.stack([np.bincount(kinds.ravel(), np.repeat(share[:, y], f), len(w)) for y in range(3)], 1)
        dw, dt = (gold_w - have) / n - ridge * w, (gold_t - pair) / n - ridge * t
        gw += dw**2
        gt += dt**2
        w += 0.3 * dw / np.sqrt(gw)
        t += 0.3 * dt / np.sqrt(gt)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of chains of emissions ``e``; ``first`` marks where a chain begins."""
    n = len(e)
    out = np.zeros(n, np.int8)
    if not n:
        return out
    slack = 2 * (t.max() - t.min())
    unsure = e[:, 0] - e[:, 1:].max(1) <= slack
    begin = unsure & (first | np.r_[True, ~unsure[:-1]])
    at = np.flatnonzero(begin)
    if not len(at):
        return out
    stop = unsure & np.r_[begin[1:] | ~unsure[1:] | first[1:], True]
    length = np.flatnonzero(stop) + 1 - at
    for k in np.unique(length):
        lo = at[length == k]
        score = e[lo] + np.where(first[lo, None], 0.0, t[0])
        back = np.zeros((k, len(lo), 3), np.int8)
        for i in range(1, k):
            x = score[:, :, None] + t
            back[i] = x.argmax(1)
            score = x.max(1) + e[lo + i]
        ends = lo + k
        score = score + np.where(((ends < n) & ~first[np.minimum(ends, n - 1)])[:, None], t[:, 0], 0.0)
        y = score.argmax(1)
        for i in range(k - 1, -1, -1):
            out[lo + i] = y
            y = back[i][np.arange(len(lo)), y]
    return out


def _labels(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """B and I for the tokens of the base matches' secrets (of an assignment: its value)."""
    y = np.zeros(len(starts), np.int8)
    for d in np.unique(doc):
        text = bytes(data[offsets[d] : offsets[d + 1]])
        for lo, kind, hi in base_spans(text):
            if kind == 0:
                lo = ASSIGN.match(text, lo).start(2)
            i, j = np.searchsorted(ends, offsets[d] + lo, side="right"), np.searchsorted(starts, offsets[d] + hi)
            y[i:j] = 2
            y[i : i + 1] = 1
    return y


#: Length bucket and shape bits of the other secrets that a positive window is also shown as: short and long, hex, lower
#: case with digits, both cases, and with symbols.
_VARIANTS = ((8, 9), (9, 11), (11, 11), (9, 15), (10, 15), (11, 15), (12, 15), (12, 31), (13, 31))


def _varied(codes: np.ndarray, labels: np.ndarray, variant: int) -> np.ndarray:
    """Positive windows without key word and assignment: variant 0 as they are, others with another length and shape."""
    x, hit = codes.copy(), labels > 0
    x[:, :, _KEY_FEATURE] = _AT[_KEY_FEATURE]
    x[hit, 3] = _AT[3] + 16
    x[hit, 4] = _AT[4] + 16
    if variant:
        bucket, shape = _VARIANTS[variant - 1]
        x[hit, 0] = _AT[0] + bucket
        x[hit, 1] = _AT[1] + shape
        x[hit, 9] = _AT[9] + bucket * 64 + shape
        x[hit, 2] = _AT[2] + 2 * 5 + 4
    return x


def train(docs: DataFrame, *, text: str, key: str, sample: int = 400, window: int = 24, most_chars: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Fit on windows of at most ``2 * sample`` documents of less than ``most_chars`` characters (the documented bound).

    Documents are ranked by the hash of their key; where a key has several texts, the one with the smallest hash is taken.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).filter(F.col("_k").isNotNull() & (F.char_length("_t") < most_chars))
    likely = F.lit(False)
    for word in ("passw", "secret", "token", "api", "AKIA", "key"):
        likely = likely | F.col("_t").contains(word)
    found = []
    for part in (rows.filter(likely & F.col("_t").rlike("[0-9][^ ]{5}|AKIA")), rows):
        # keys alone are ranked, so that a task sends no texts; then the texts of these keys
        keys = [r["_k"] for r in part.select("_k").distinct().orderBy(F.xxhash64("_k"), "_k").limit(sample).collect()]
        texts = part.filter(F.col("_k").isin(keys)).groupBy("_k").agg(F.min(F.struct(F.xxhash64("_t"), "_t")).alias("_m")).select("_k", "_m._t").collect() if keys else []
        found += [r["_t"] for r in sorted(texts, key=lambda r: r["_k"])]
    xs, ys = [], []
    for at in range(0, len(found), 50):
        data, offsets = flat(pa.array(found[at : at + 50], pa.large_string()))
        starts, ends, doc, codes = features(data, offsets)
        y = _labels(starts, ends, doc, offsets, data)
        where = np.flatnonzero(y == 1)
        spread = np.arange(0, len(y), max(1, len(y) // 400))
        centre = np.clip(np.r_[where, spread] - window // 2, 0, max(0, len(y) - window))
        if len(y) < window:
            continue
        rows_at = centre[:, None] + np.arange(window)
        xs.append(codes[rows_at])
        ys.append(y[rows_at])
        for variant in range(len(_VARIANTS) + 1):
            xs.append(_varied(codes[rows_at[: len(where)]], y[rows_at[: len(where)]], variant))
            ys.append(y[rows_at[: len(where)]])
    if not xs or not any((y > 0).any() for y in ys):
        return np.tile([0.0, -10.0, -10.0], (sum(SIZES), 1)), np.zeros((3, 3))  # nothing to learn from: all O
    return fit(np.concatenate(xs), np.concatenate(ys))


def _code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    seen = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(seen[i - 1]) if i else 0
    return [(at(lo), kind, at(hi)) for lo, kind, hi in spans]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def find_secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id", sample: int = 400, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row a document: key, n_assign, n_access, n_hex, base_sha256, spans, n_crf.

    Spans are kind:start:end in code points, by start and then kind; base spans stay, and the CRF's are those that touch
    none of them.  Null texts are empty; rows without spans have the digest of the empty string and an empty list;
    repeated rows and null keys are answered row by row; an empty table gives no rows (and trains on nothing).  A text of
    any length is scanned whole, a very long one as a block of its own; further columns are ignored.
    """
    w, t = model or train(docs, text=text, key=key, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), t.astype(np.float32)))  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for b in blocks(batches, "_t"):
            data, offsets = flat(b.column("_t"))
            starts, ends, doc, codes = features(data, offsets)
            e = np.zeros((len(starts), 3), np.float32)
            for k in range(codes.shape[1]):
                e += w[codes[:, k]]
            y = viterbi(e, t, np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool))
            tagged = np.flatnonzero(y)
            goes_on = (y[tagged] == 2) & np.r_[False, (np.diff(tagged) == 1) & (doc[tagged][1:] == doc[tagged][:-1])] if len(tagged) else np.zeros(0, bool)
            heads = np.flatnonzero(~goes_on)
            tails = np.r_[heads[1:], len(tagged)] - 1 if len(heads) else heads
            of: dict[int, list[tuple[int, int]]] = {}
            for h, tail in zip(tagged[heads], tagged[tails], strict=True):
                d = int(doc[h])
                of.setdefault(d, []).append((int(starts[h] - offsets[d]), int(ends[tail] - offsets[d])))
            rows = {"n": [[], [], [], []], "sha": [], "spans": []}
            raw = data.tobytes()
            for d in range(b.num_rows):
                one = raw[offsets[d] : offsets[d + 1]]
                base = base_spans(one)
                more = [(lo, 3, hi) for lo, hi in of.get(d, ()) if not any(lo < q and p < hi for p, _, q in base)]
                for k in range(3):
                    rows["n"][k].append(sum(x[1] == k for x in base))
                rows["n"][3].append(len(more))
                points = _code_points(one, sorted(base + more)) if base or more else []
                rows["sha"].append(hashlib.sha256(_joined([x for x in points if x[1] < 3]).encode()).hexdigest())
                rows["spans"].append(_joined(points))
            yield pa.RecordBatch.from_arrays([b.column("_k"), *(pa.array(x, pa.int64()) for x in rows["n"][:3]), pa.array(rows["sha"]), pa.array(rows["spans"]), pa.array(rows["n"][3], pa.int64())], ["_k", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    found = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t")).mapInArrow(lean(run), "_k long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
    return found.withColumnRenamed("_k", key)

"""Chat formatting by columnar byte assembly.

A turn is written ``<s>[INST]role[/INST]text</s>``.  Control strings inside roles and texts get one more backslash
after their first character (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which ``unescape`` takes away again,
so what is read back equals what went in.

All turns of a block of rows are assembled at once: segment lengths (header, role, middle, text, end) give cumulative
offsets, the offsets give a scatter index for each source byte, and headers and contents are copied into one
preallocated Arrow buffer whose offsets are the conversations' borders.
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

from .common import blocks, flat

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.S)
_ARROW_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"

FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:int,length:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _scatter(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Target index of each byte of segments with these lengths that begin at ``at``."""
    ends = np.cumsum(lengths)
    return np.repeat(at - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Array, list]:
    """Format rows in order; equal neighbours in ``conv`` make one conversation.  Loss spans are in code points."""
    escaped = [pc.replace_substring_regex(pc.fill_null(x, ""), _ARROW_CONTROL, r"\1\2\\\3") for x in (roles, texts)]
    (role_bytes, role_off), (text_bytes, text_off) = map(flat, escaped)
    n, fixed = len(conv), [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, [0, 2, 4]] = [len(x) for x in fixed]
    lengths[:, 1], lengths[:, 3] = np.diff(role_off), np.diff(text_off)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    at = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, segment in zip((0, 2, 4), fixed, strict=True):
        out[at[:, k, None] + np.arange(len(segment))] = segment
    out[_scatter(lengths[:, 1], at[:, 1])] = role_bytes
    out[_scatter(lengths[:, 3], at[:, 3])] = text_bytes
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]) if n else np.zeros(0, np.int64)
    borders = np.r_[at[first, 0], ends[-1, -1]] if n else np.zeros(1, np.int64)
    made = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(borders.astype(np.int64)), buffer])
    chars = np.empty((n, 5), np.int64)
    chars[:, [0, 2, 4]] = lengths[:, [0, 2, 4]]
    for k, x in ((1, escaped[0]), (3, escaped[1])):
        chars[:, k] = pc.utf8_length(x).to_numpy(zero_copy_only=False)
    char_at = np.cumsum(chars.ravel()).reshape(n, 5) - chars
    is_loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
    to = np.r_[first[1:], n]
    loss = [[{"start": int(char_at[i, 3] - char_at[a, 0]), "length": int(chars[i, 3])} for i in range(a, b) if is_loss[i]] for a, b in zip(first, to, strict=True)]
    return conv[first], made, loss


def format_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted conversations: conv_id, part, formatted, loss (spans of the assistants' escaped texts).

    Rows are dealt by conversation and sorted by turn (ties: by role, then text, nulls first).  A conversation that is
    longer than a block of bytes comes out as several parts, numbered in order, so no task holds an unbounded one; the
    concatenation of the parts is its formatted text.  Null texts and roles are empty; a null conv_id groups like a
    value; empty tables give no rows; extra columns are ignored.
    """
    sized = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    dealt = sized.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for b in blocks(batches, "text"):
            ids = b.column("conv_id")
            codes = np.r_[0, np.cumsum(pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) != pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False)))] if len(ids) > 1 else np.zeros(len(ids), np.int64)
            kept, made, loss = assemble(codes, b.column("role"), b.column("text"))
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            convs = ids.take(pa.array(first))
            parts = np.zeros(len(kept), np.int64)
            if convs[0].as_py() == last:
                parts[0] = part + 1
            last, part = convs[-1].as_py(), int(parts[-1])
            yield pa.RecordBatch.from_arrays([convs, pa.array(parts), made.cast(pa.string()), pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], ["conv_id", "part", "formatted", "loss"])

    return dealt.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted text and its loss spans alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline a turn), loss_chars, loss_sha256, formatted_chars.  Null
    texts came in as empty ones; a very long conversation comes in parts, over which the digests go on; an empty table
    gives no rows.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def closed() -> dict:
            return {"conv_id": now[0], "n_turns": held[0], "turns_sha256": held[1].hexdigest(), "loss_chars": held[2], "loss_sha256": held[3].hexdigest(), "formatted_chars": held[4]}

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if now != (r["conv_id"],):
                    if now is not None:
                        rows.append(closed())
                    now, held = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                s = r["formatted"]
                for m in _TURN.finditer(s):
                    held[0] += 1
                    held[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for x in r["loss"]:
                    said = unescape(s[x["start"] : x["start"] + x["length"]])
                    held[2] += len(said)
                    held[3].update(said.encode())
                held[4] += len(s)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
        if now is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema=out)

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

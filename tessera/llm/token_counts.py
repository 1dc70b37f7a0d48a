"""Edit-aware token counts: pre-token segment trees, of which an edit re-encodes only what it touches.

A text is cut into leaves of whole pre-tokens.  A cut lies before a blank that stands between two other characters than
white space: the splitting pattern ends a pre-token there whatever is around, so leaves encode alone as they do in
the text, and counts add up.  Each document's tree is balanced by height; its nodes hold the characters and tokens below
them.  A stretch of leaves that no edit has come near is one node, which is opened only on the way to an edit.

An edit descends by character sums to the leaves it touches, takes a neighbour along where it comes within two characters
of a cut (the boundary context that could make the cut invalid), cuts the changed text anew, encodes only pieces that are
not old leaves, and joins the trees before and after them with these, which makes new nodes on the paths to the root alone:
neither the other leaves nor the other sums nor the rest of the text are copied.  The stored state is the leaves' two
integer lists beside the text, so trees survive between jobs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, free_name, lean

#: Characters of a leaf at least, where a cut is possible.
LEAF_CHARS = 256
_WHITE = np.zeros(0x3001, bool)
_WHITE[:0x21] = True
_WHITE[[0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_WHITE[0x2000:0x2010] = True


def cuts(text: str, leaf: int = 0) -> list[int]:
    """Borders of the leaves, from 0 to the length: the first safe cut after each ``leaf`` characters."""
    leaf = leaf or LEAF_CHARS
    n = len(text)
    out = [0]
    if n > leaf:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        white = (code < len(_WHITE)) & _WHITE[np.minimum(code, len(_WHITE) - 1)]
        safe = np.flatnonzero((code[1:-1] == 32) & ~white[:-2] & ~white[2:]) + 1
        at = int(np.searchsorted(safe, leaf))
        while at < len(safe):
            out.append(int(safe[at]))
            at = int(np.searchsorted(safe, safe[at] + leaf))
    return [*out, n]


class Encoder:
    """Counts tokens with a tiktoken rank file; made once a worker."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def count(self, pieces: list[str]) -> list[int]:
        return [len(self.encoding.encode_ordinary(p)) for p in pieces]


class Node:
    """A part of a tree: its characters, its tokens and its height (0: a leaf)."""

    __slots__ = ("chars", "tokens", "height", "left", "right", "piece")

    def __init__(self, chars: int, tokens: int, height: int = 0, left: Node | None = None, right: Node | None = None, piece: str = ""):
        self.chars, self.tokens, self.height, self.left, self.right, self.piece = chars, tokens, height, left, right, piece

    def open(self) -> tuple[Node, Node]:
        return self.left, self.right

    def leaves(self) -> Iterator[tuple[str, list[int], list[int]]]:
        """Text, characters and tokens of stretches of leaves, in order."""
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Stretch):
                yield node.all()
            elif node.height:
                todo += [node.right, node.left]
            else:
                yield node.piece, [node.chars], [node.tokens]


class Stretch(Node):
    """Leaves lo..hi of a text as they were stored, which halve when they are opened."""

    __slots__ = ("text", "ends", "sums", "lo", "hi")

    def __init__(self, text: str, ends: np.ndarray, sums: np.ndarray, lo: int, hi: int):
        super().__init__(int(ends[hi] - ends[lo]), int(sums[hi] - sums[lo]), (hi - lo - 1).bit_length())
        self.text, self.ends, self.sums, self.lo, self.hi = text, ends, sums, lo, hi

    def open(self) -> tuple[Node, Node]:
        if self.left is None:
            half = (self.lo + self.hi + 1) // 2
            self.left, self.right = Stretch(self.text, self.ends, self.sums, self.lo, half), Stretch(self.text, self.ends, self.sums, half, self.hi)
        return self.left, self.right

    def all(self) -> tuple[str, list[int], list[int]]:
        lo, hi = self.lo, self.hi
        return self.text[self.ends[lo] : self.ends[hi]], np.diff(self.ends[lo : hi + 1]).tolist(), np.diff(self.sums[lo : hi + 1]).tolist()


def _over(left: Node, right: Node) -> Node:
    return Node(left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height), left, right)


def join(left: Node | None, right: Node | None) -> Node | None:
    """One tree of both, balanced if they are; new nodes are made along one path, as long as the heights differ."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        a, b = left.open()
        t = join(b, right)
        if t.height <= a.height + 1:
            return _over(a, t)
        x, y = t.open()
        if x.height <= y.height:
            return _over(_over(a, x), y)
        p, q = x.open()
        return _over(_over(a, p), _over(q, y))
    if right.height > left.height + 1:
        a, b = right.open()
        t = join(left, a)
        if t.height <= b.height + 1:
            return _over(t, b)
        x, y = t.open()
        if y.height <= x.height:
            return _over(x, _over(y, b))
        p, q = y.open()
        return _over(_over(x, p), _over(q, b))
    return _over(left, right)


def cut_at(tree: Node, position: int) -> tuple[Node | None, Node, Node | None]:
    """The leaf that holds a position (the last one, if past the end), and the trees before and after it."""
    before, after = [], []
    while tree.height:
        a, b = tree.open()
        if position < a.chars:
            after.append(b)
            tree = a
        else:
            before.append(a)
            tree, position = b, position - a.chars
    left = right = None
    for x in reversed(before):
        left = join(x, left)
    for x in reversed(after):
        right = join(right, x)
    return left, tree, right


def _piece(leaf: Node) -> str:
    return leaf.all()[0] if isinstance(leaf, Stretch) else leaf.piece


class Document:
    """A text as the leaves of its tree (None: no text)."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        ends, sums = np.r_[0, np.cumsum(np.array(chars, np.int64))], np.r_[0, np.cumsum(np.array(tokens, np.int64))]
        self.tree = Stretch(text, ends, sums, 0, len(chars)) if text else None
        self.encoded = 0

    @classmethod
    def build(cls, text: str, encoder: Encoder) -> Document:
        return cls(text, *counted(text, encoder))

    @property
    def total(self) -> tuple[int, int]:
        return (self.tree.chars, self.tree.tokens) if self.tree else (0, 0)

    def state(self) -> tuple[str, list[int], list[int]]:
        """The text, and its leaves' characters and tokens."""
        parts = list(self.tree.leaves()) if self.tree else []
        return "".join(p for p, _, _ in parts), [x for _, c, _ in parts for x in c], [x for _, _, n in parts for x in n]

    def edit(self, start: int, delete: int, insert: str, encoder: Encoder) -> None:
        """Replace ``delete`` characters from ``start`` on (both clipped to the text) by ``insert``."""
        n = self.total[0]
        start = min(max(0, start), n)
        end = min(n, start + max(0, delete))
        before, after, touched = None, None, []  # touched: where a leaf begins, and the leaf
        if self.tree:
            before, leaf, after = cut_at(self.tree, start)
            begin = before.chars if before else 0
            touched, stop = [(begin, leaf)], begin + leaf.chars
            if start - begin < 2 and before:
                before, leaf, _ = cut_at(before, before.chars)
                touched.insert(0, (begin - leaf.chars, leaf))
            if end >= stop and after:  # what lies between the two leaves goes as a whole
                gone, leaf, after = cut_at(after, end - stop)
                stop += gone.chars if gone else 0
                touched.append((stop, leaf))
                stop += leaf.chars
            if stop - end < 2 and after:
                _, leaf, after = cut_at(after, 0)
                touched.append((stop, leaf))
        known = {_piece(leaf): leaf.tokens for _, leaf in touched}
        head = "".join(_piece(leaf)[: max(0, start - at)] for at, leaf in touched)
        tail = "".join(_piece(leaf)[max(0, end - at) :] for at, leaf in touched)
        new = head + insert + tail
        border = cuts(new)
        pieces = [p for p in (new[x:y] for x, y in zip(border, border[1:], strict=False)) if p]
        todo = [p for p in pieces if p not in known]
        self.encoded += sum(map(len, todo))
        known |= dict(zip(todo, encoder.count(todo), strict=True))
        inner = None
        for p in pieces:
            inner = join(inner, Node(len(p), known[p], piece=p))
        self.tree = join(join(before, inner), after)


def counted(text: str, encoder: Encoder) -> tuple[list[int], list[int]]:
    """Characters and tokens of a text's leaves."""
    border = cuts(text)
    pieces = [p for p in (text[a:b] for a, b in zip(border, border[1:], strict=False)) if p]
    return [len(p) for p in pieces], encoder.count(pieces)


_TREE = [T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("leaf_digest", T.LongType())]
EDITS = "array<struct<start:long,n_delete:long,insert:string>>"


def _digest(text: str) -> int:
    """Signed XXH64 of the text that leaves were made of."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(text.encode()), "big", signed=True)


def _ints(lists: list) -> pa.Array:
    return pa.array(lists, pa.list_(pa.int32()))


def token_trees(docs: DataFrame, tokenizer_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and leaf_chars, leaf_tokens, leaf_digest (of the text), n_tokens (such columns are replaced).

    Null texts count as empty (no token); keys may be null or repeat; an empty table gives no rows.  A very long text has
    more leaves, all of them in its row.
    """
    plain, t = docs.drop("leaf_chars", "leaf_tokens", "leaf_digest", "n_tokens"), free_name("_t", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, pattern)
        for b in blocks(batches, t):
            texts = pc.fill_null(b.column(t), "").to_pylist()
            trees = [counted(x, encoder) for x in texts]
            k = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:k], _ints([c for c, _ in trees]), _ints([n for _, n in trees]), pa.array([_digest(x) for x in texts], pa.int64()), pa.array([sum(n) for _, n in trees], pa.int64())], [*b.schema.names[:k], "leaf_chars", "leaf_tokens", "leaf_digest", "n_tokens"])

    return plain.select("*", F.col(f"`{text}`").cast("string").alias(t)).mapInArrow(lean(run), T.StructType([*plain.schema.fields, *_TREE, T.StructField("n_tokens", T.LongType())]))


def apply_edits(trees: DataFrame, tokenizer_path: str, pattern: str, *, text: str = "text", edits: str = "edits") -> DataFrame:
    """Apply each row's edits in turn: the text, leaf_chars, leaf_tokens and n_tokens are those after the edits.

    ``trees`` comes from ``token_trees`` (where leaves are null or are not of this text, by its digest, they are made anew) and has the column ``edits`` (see EDITS; null: none), whose starts refer to the
    text as the edits before left it.  Adds n_tokens_before and n_encoded_chars, the characters that were encoded again.
    """
    rest = [c for c in trees.columns if c not in (text, edits, "leaf_chars", "leaf_tokens", "leaf_digest", "n_tokens", "n_tokens_before", "n_encoded_chars")]
    own = [free_name(n, trees.columns) for n in ("_t", "_c", "_n", "_b", "_e", "_d")]
    digest = F.col("leaf_digest") if "leaf_digest" in trees.columns else F.lit(None).cast("long")
    given = trees.select(*[F.col(f"`{c}`") for c in rest], *[c.alias(n) for c, n in zip((F.col(f"`{text}`").cast("string"), F.col("leaf_chars"), F.col("leaf_tokens"), F.col("n_tokens"), F.col(f"`{edits}`").cast(EDITS), digest), own, strict=True)])
    fields = [*(trees.schema[c] for c in rest), T.StructField(text, T.StringType()), *_TREE, T.StructField("n_tokens", T.LongType()), T.StructField("n_tokens_before", T.LongType()), T.StructField("n_encoded_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, pattern)
        for b in blocks(batches, own[0]):
            done = []
            for t, c, n, e, of in zip(*(b.column(own[i]).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                t = t or ""
                fits = c is not None and n is not None and len(c) == len(n) and sum(c) == len(t) and of == _digest(t)
                d = Document(t, c, n) if fits else Document.build(t, encoder)
                for x in e or ():
                    d.edit(x["start"] or 0, x["n_delete"] or 0, x["insert"] or "", encoder)
                done.append(d)
            texts, chars, tokens = zip(*(d.state() for d in done), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(texts, pa.string()), _ints(chars), _ints(tokens), pa.array([_digest(t) for t in texts], pa.int64()), pa.array([d.total[1] for d in done], pa.int64()), b.column(own[3]), pa.array([d.encoded for d in done], pa.int64())], [f.name for f in fields])

    return given.mapInArrow(lean(run), T.StructType(fields))


def with_edits(trees: DataFrame, edits: DataFrame, *, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Join a table of edits (key, seq, start, n_delete, insert) to the trees, each document's in the order of ``seq``."""
    own = free_name("_key", trees.columns)
    each = edits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seq, "start", "n_delete", "insert"))).alias("_s"))
    each = each.select(F.col(key).alias(own), F.transform("_s", lambda x: F.struct(x["start"], x["n_delete"], x["insert"])).cast(EDITS).alias("edits"))
    return trees.join(each, F.col(key) == F.col(own), "left").drop(own)

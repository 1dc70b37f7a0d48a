"""Token-ID / binary output: flat unsigned integer files, 64-bit document offsets, bases from prefix sums.

Layout of one written set (a folder in the shared store):

* ``part-<k>-<attempt>.bin``  the ids of the documents of range partition ``k``, back to back, little-endian
  ``uint16`` where the vocabulary has at most 65,536 ids, else ``uint32``.
* ``part-<k>-<attempt>.idx``  little-endian 64-bit integers: n, the number of null document ids (they are the first, and
  stored as 0), then n document ids, then n + 1 offsets in ids.
* the manifest, a DataFrame with a row a part: its files, counts and ``base`` - the ids of all parts before it,
  an exclusive prefix sum over the parts' counts (one row a partition is all that the driver sees).

Files are named for the task attempt, and the manifest names the attempt that won, so that a lost executor or a
speculative copy leaves only unread files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh_path, lean, ranges_for, store_of, written

#: Words whose ids a worker remembers in each of two generations, and the characters of the longest of them.
CACHE_WORDS = 120_000
CACHE_CHARS = 64
#: Longer texts are encoded in pieces of about this many characters.
CHUNK_CHARS = 1 << 20
#: Characters on which Python's and the tokenizers' notions of white space may differ; texts with them are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class _Words(dict):
    """Packed ids by space-parted word, in two generations: a full one becomes the older one, so what is in use stays.

    At most ``2 * CACHE_WORDS`` words of up to ``CACHE_CHARS`` characters are held, some 60 MB.
    """

    def __init__(self, model, split, code: str):
        self.model, self.split, self.code, self.older, self.letters = model, split, code, {}, _byte_letters()

    def _merged(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [x.id for x in self.model.tokenize(symbols)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if (found := self.older.get(word)) is None:
            if word.isalpha():
                found = self._merged(word)
            elif word[-1] in ".," and word[:-1].isalpha():
                found = self[word[:-1]] + self[word[-1]]
            else:
                found = b"".join(map(self._merged, self.split(word)))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class WordEncoder:
    """Encodes texts with a tokenizers file, remembering the ids of space-parted words.

    For tokenizers that normalize by NFC, white space and lower case, part by a pattern that never holds white space, and
    then merge bytes - as ``word_bpe_49k.json`` does - words of texts in Latin-1 are parted by the file's own pattern and
    go to the merges; tests compare with whole-text encoding.  Any other text or tokenizer is encoded by the library.
    """

    _made: dict[tuple[str, str], WordEncoder] = {}

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), "H" if dtype == "<u2" else "I"
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])]
        parts = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        self.added = [x["content"] for x in told["added_tokens"]]
        self.words = _Words(self.tokenizer.model, regex.compile(parts[0]["pattern"]["Regex"]).findall, self.code) if self.plain else {}

    @classmethod
    def of(cls, path: str, dtype: str) -> WordEncoder:
        """The worker's only encoder of this kind: what it has learnt serves its later tasks."""
        if (path, dtype) not in cls._made:
            cls._made[path, dtype] = cls(path, dtype)
        return cls._made[path, dtype]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if not (text.isascii() or _latin(text)) or _ODD_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.plain or any(x in text for x in self.added):
                yield self._whole(text)
            elif len(text) > CHUNK_CHARS:  # no pre-token holds a blank, so cuts there change nothing
                yield b"".join(map(self._part, _chunks(text)))
            else:
                yield self._part(text)


def _chunks(text: str) -> Iterator[str]:
    """The text in pieces of about ``CHUNK_CHARS`` characters, cut before a blank where there is one."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + CHUNK_CHARS // 2)
        to = len(text) if to < 0 else to
        yield text[at : to + 1]
        at = to + 1


def _latin(text: str) -> bool:
    """Whether all is in Latin-1, where lower-casing and NFC act on each character alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, *, text: str = "text", key: str = "doc_id", vocab: int = 65536, encoder: Callable | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write the files in ascending order of ``key``.

    Returns the manifest: part, bin, idx, n_docs, n_tokens, base, width.  A null text is empty (one end id); null keys
    come first and are told from all others; rows with equal keys are all kept, in the order of their texts' hashes, and
    may be spread over ranges; an empty table gives a manifest without rows.  Other columns are ignored.  The text goes
    through one range exchange, whose files are dropped once the token files are there, and is encoded after it.
    """
    spark = docs.sparkSession
    out = fresh_path(spark, "tokens")
    dtype = "<u2" if vocab <= 65536 else "<u4"
    make = encoder or WordEncoder.of

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = make(tokenizer_path, dtype), np.array([end_id], dtype).tobytes()
        name, ids, nulls, counts, sink = f"{out}/part-{part:06d}-{uuid.uuid4().hex[:8]}", [], 0, [0], None
        for b in blocks(batches, "_t"):
            if sink is None:
                store, root = store_of(out)
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(store_of(f"{name}.bin")[1])
            for x in encode(pc.fill_null(b.column("_t"), "").to_pylist()):
                sink.write(x + end)
                counts.append(len(x) // len(end) + 1)
            nulls += b.column("_k").null_count
            ids.append(pc.fill_null(b.column("_k"), 0).to_numpy(zero_copy_only=False).astype("<i8"))
        if sink is not None:
            sink.close()
            ids = np.concatenate(ids)
            with store.open_output_stream(store_of(f"{name}.idx")[1]) as f:
                f.write(np.concatenate([np.array([len(ids), nulls], "<i8"), ids, np.cumsum(counts).astype("<i8")]).tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "bin": [f"{name}.bin"], "idx": [f"{name}.idx"], "n_docs": [len(ids)], "n_tokens": [int(sum(counts))]})

    schema = "part long, bin string, idx string, n_docs long, n_tokens long"
    use = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t")).withColumn("_h", F.xxhash64("_t"))
    ranged = use.repartitionByRange(ranges_for(use), "_k", "_h").sortWithinPartitions("_k", "_h")
    parts = sorted(written(ranged.mapInArrow(lean(write), schema), "token-parts").collect())  # a row a partition
    base, rows = 0, []
    for p in parts:
        rows.append((*p, base, np.dtype(dtype).itemsize))
        base += p["n_tokens"]
    return spark.createDataFrame(rows, schema + ", base long, width int").repartition(max(1, len(rows)), "part") if rows else spark.createDataFrame([], schema + ", base long, width int")


def _opened(uri: str, dtype: str) -> np.ndarray:
    """The file, memory-mapped where the store is a mounted file system, else read through pyarrow."""
    store, path = store_of(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(manifest: DataFrame, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row a document, from the files: key, start, n_tokens, ids_crc32 (and ids with ``with_ids``).

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as little-endian uint32.  A document
    of a null or empty text has its end id alone, a null key comes back as null, and an empty table gives no rows; of a very
    long document the ids are one stretch of its file, which is mapped, not read as a whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                idx, ids = _opened(r["idx"], "<i8"), _opened(r["bin"], f"<u{r['width']}")
                n, nulls, idx = int(idx[0]), int(idx[1]), idx[2:]
                off = idx[n : 2 * n + 1]
                for at in range(0, n, 4096):
                    to = min(n, at + 4096)
                    rows = {key: pa.array(idx[at:to], mask=np.arange(at, to) < nulls), "start": pa.array(off[at:to] + r["base"]), "n_tokens": pa.array(np.diff(off[at : to + 1])), "ids_crc32": pa.array([zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4")) for i in range(at, to)], pa.int64())}
                    if with_ids:
                        rows["ids"] = pa.array([ids[off[i] : off[i + 1]].astype(np.int64) for i in range(at, to)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(rows)

    return manifest.mapInArrow(lean(read), f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)

"""Counts after edits against encoding the whole edited text."""

import os

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
ALPHABET = list("ab é.  \n\t'12") + ["don't", " ", "　", "𝒳", " the", "\x1c", "  "]


@pytest.fixture(scope="module")
def encoder():
    from tessera.llm.token_counts import Encoder

    return Encoder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def balanced(node):
    """Sums and heights are those of the parts, and heights differ by one at most."""
    if node is None or not node.height:
        return
    a, b = node.open()
    assert (node.chars, node.tokens) == (a.chars + b.chars, a.tokens + b.tokens) and abs(a.height - b.height) <= 1
    assert node.height >= 1 + max(a.height, b.height)
    balanced(a)
    balanced(b)


def test_an_edit_opens_one_path(encoder):
    from tessera.llm.token_counts import Document, Node

    d, made = Document.build("the quick brown fox " * 200_000, encoder), []
    old, init = d.tree, Node.__init__
    Node.__init__ = lambda self, *a, **k: (made.append(1), init(self, *a, **k))[1]
    try:
        d.edit(2_000_000, 40, " leaps over", encoder)
        d.edit(1_000, 5, "", encoder)
    finally:
        Node.__init__ = init
    assert old.height > 12 and len(made) < 20 * old.height and d.encoded < 3000


def test_trees_and_edits_equal_whole_texts(encoder, monkeypatch):
    from tessera.llm import token_counts as m

    monkeypatch.setattr(m, "LEAF_CHARS", 8)
    rng = np.random.default_rng(12)
    whole = lambda t: len(encoder.encoding.encode_ordinary(t))
    for _ in range(120):
        text = "".join(rng.choice(ALPHABET, int(rng.integers(0, 120))))
        d = m.Document.build(text, encoder)
        assert d.total == (len(text), whole(text))
        for _ in range(12):
            at, gone = int(rng.integers(0, len(text) + 3)), int(rng.integers(0, 9))
            new = "".join(rng.choice(ALPHABET, int(rng.integers(0, 7))))
            text = text[:at] + new + text[at + gone :]
            d.edit(at, gone, new, encoder)
            got, chars, tokens = d.state()
            assert got == text and d.total == (len(text), whole(text)) == (sum(chars), sum(tokens))
            balanced(d.tree)


def test_edits_encode_little(spark, encoder):
    from tessera.llm.token_counts import apply_edits, token_trees, with_edits

    texts = [(1, "the quick brown fox jumps " * 4000), (2, None), (3, ""), (None, "x" * 3000), (1, "the quick brown fox jumps " * 4000)]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, n_tokens int").withColumnsRenamed({}).selectExpr("*", "7 as _t", "8 as _key", "9 as _c")
    edits = spark.createDataFrame([(1, 1, 50, 3, "slow"), (1, 2, 60000, 0, " new words"), (2, 1, 0, 9, "born"), (9, 1, 0, 0, "x")], "doc_id long, seq int, start long, n_delete long, insert string")
    path = P.path("byte_bpe_50k.tiktoken")
    got = apply_edits(with_edits(token_trees(df, path, P.PATTERN), edits), path, P.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        assert r["n_tokens"] == len(encoder.encoding.encode_ordinary(r["text"]))
        assert sum(r["leaf_tokens"]) == r["n_tokens"] and r["n_encoded_chars"] < 3000
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["born"]
    assert token_trees(df.limit(0), path, P.PATTERN).collect() == []
    bare = df.selectExpr("doc_id", "text", "cast(null as array<int>) as leaf_chars", "array(1) as leaf_tokens", "1L as n_tokens", "array(named_struct('start', 1L, 'n_delete', cast(null as bigint), 'insert', 'x')) as edits")
    for r in apply_edits(bare, path, P.PATTERN).collect():
        assert "x" in r["text"] and r["n_tokens"] == sum(r["leaf_tokens"]) == len(encoder.encoding.encode_ordinary(r["text"]))


def test_leaves_of_another_text_are_made_anew(spark, encoder):
    from pyspark.sql import functions as F

    from tessera.llm.token_counts import apply_edits, token_trees

    path = P.path("byte_bpe_50k.tiktoken")
    long = "a very long text, 42 " * 60_000
    trees = token_trees(spark.createDataFrame([(1, "aaaa bbbb cccc"), (2, long)], "doc_id long, text string"), path, P.PATTERN)
    other = trees.withColumns({"text": F.when(F.col("doc_id") == 1, "x9!x9!x9!x9!x9").otherwise(F.col("text")), "edits": F.expr("array(named_struct('start', 0L, 'n_delete', 0L, 'insert', 'z'))")})
    got = {r["doc_id"]: r for r in apply_edits(other, path, P.PATTERN).collect()}
    for k, text in ((1, "zx9!x9!x9!x9!x9"), (2, "z" + long)):
        assert got[k]["text"] == text and got[k]["n_tokens"] == len(encoder.encoding.encode_ordinary(text))
    assert got[2]["n_encoded_chars"] < 2000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_the_registered_query_counts_edited_texts(spark, encoder):
    from tessera.llm.queries import op3_token_counts

    count = lambda t: len(encoder.encoding.encode_ordinary(t))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op3_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        t = texts[r["doc_id"]]
        n = len(t)
        e = t[: n // 4] + t[n // 4 + 30 :]
        e = e[: n // 2] + " an inserted remark, 42" + e[n // 2 :]
        assert (r["n_tokens"], r["n_tokens_edited"]) == (count(t), count(e + t[:25]))

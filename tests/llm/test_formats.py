"""Token files, chat formatting and mixing against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

TEXTS = [None, "", " \t\n", "Hello, world.", "hello hello", "İstanbul ß É é", "a\x1cb \x85 c", "<|endoftext|> x", "don't stop!!", "x" * 5000, "Hello, world.", "l'été n'est 12,5%"]


def docs(spark, texts=TEXTS, sources=None):
    return spark.createDataFrame([(i * 3, t, (sources or ["s"])[i % len(sources or ["s"])], i) for i, t in enumerate(texts)], "doc_id long, text string, source string, _s long")


def test_token_files_equal_whole_text_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tessera.llm.token_files import read_tokens, write_tokens

    path = P.path("word_bpe_49k.json")
    got = sorted(read_tokens(write_tokens(docs(spark).repartition(3), path, 2, vocab=49408), with_ids=True).collect())
    t, start = Tokenizer.from_file(path), 0
    for r, text in zip(got, TEXTS, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_null_and_equal_keys_and_long_words(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tessera.llm.token_files import read_tokens, write_tokens

    least = -(2**63)
    rows = [(None, "a b"), (1, None), (1, "zz"), (None, ""), (0, "ok, ok.. 'tis 5x\u00b2"), (least, "q"), (2, "a" * 3000 + " b" * 900_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    path = P.path("word_bpe_49k.json")
    found = read_tokens(write_tokens(docs, path, 2), with_ids=True).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r["doc_id"] for r in found] == [None, None, least, 0, 1, 1, 2]
    assert sorted(r["ids"] for r in found) == sorted(encode(t) for _, t in rows)
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1]]


def test_token_files_of_nothing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tessera.llm.token_files import read_tokens, write_tokens

    assert read_tokens(write_tokens(docs(spark).limit(0), P.path("word_bpe_49k.json"), 2)).collect() == []


@pytest.mark.parametrize("block", [40, 1 << 21])
def test_chat_round_trip(spark, monkeypatch, block):
    from tessera.llm import chat_format

    monkeypatch.setattr(chat_format, "blocks", lambda b, c, n=block, f=chat_format.blocks: f(b, c, n))
    said = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s>[\\INST]", None, "", "é" * 70, "<s>", "a\nb"]
    rows = [(c, t, ("user", "assistant", "[INST]\n", None)[(c + t) % 4], said[(c * 3 + t) % 7]) for c in (None, 1, 2, 3) if c for t in range(9)]
    rows += [(None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert set(got) == {None, 1, 2, 3}
    for c, r in got.items():
        mine = [x for x in rows if x[0] == c]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).collect() == []


def test_chats_with_ties_repeated_rows_and_other_columns(spark):
    """Equal turns go by role and text, nulls first; repeated rows are turns of their own."""
    from tessera.llm import chat_format

    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, "z"), (1, 0, "assistant", None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (1, None, "user", "first"), (2, 5, "assistant", "é" * 300_000)]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], "conv_id long, turn long, role string, text string, part long, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for c in (1, 2):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:2]) + tuple((x is not None, x or "") for x in r[2:]))
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_targets_share_everything():
    from tessera.llm.mixing import splitting_tree, targets

    assert targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    t = targets([1, 100, 0], [5, 2, 1])
    assert t == pytest.approx([3, 98, 0])
    q = np.array([7, 0, 20, 1])
    assert (splitting_tree(q, 5, 1).sum(axis=0) == q).all()


def test_mix_keeps_targets(spark):
    from tessera.llm.mixing import mix

    rng = np.random.default_rng(0)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 40, 900)] + [None]
    df = docs(spark, texts, ["a", "a", "a", "b", None, "ç"])
    got = mix(df).collect()
    assert mix(df).count() == len(got) and {r["doc_id"] for r in got} == {i * 3 for i in range(901)}
    by = {}
    for r in got:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["mix_copies"] <= 3
        x = by.setdefault(r["source"], [r["mix_target"], 0])
        x[1] += r["mix_size"] * (r["mix_copy"] is not None)
    assert list(sorted(by, key=lambda s: (s is None, s))) == ["a", "b", "ç", None]
    for goal, taken in by.values():
        assert abs(goal - taken) <= 25
    assert sum(g for g, _ in by.values()) == pytest.approx(sum(len((t or "").split()) for t in texts))
    assert mix(df.limit(0)).collect() == []

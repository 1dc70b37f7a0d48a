"""Leaks against alignment of every item with every whole document."""

import numpy as np


def plain_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_align_equals_plain():
    from tessera.llm.decontaminate import align

    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 6, int(rng.integers(1, 15))), rng.integers(0, 6, int(rng.integers(1, 30)))
        assert align(a, b)[0] == plain_sw(a, b)


def test_leaks_equal_brute_force(spark):
    import re

    from tessera.llm.decontaminate import decontaminate, leaks

    rng = np.random.default_rng(7)
    vocab = ["the", "of", "and", "à"] * 6 + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, 30))) for i in range(8)] + [(50, "w1 w2"), (51, ""), (52, None)]
    rows = []
    for d in range(60):
        words = list(rng.choice(vocab, 120))
        if d % 3:
            leak = items[d % 8][1].split()
            for _ in range(d % 7):
                p = int(rng.integers(len(leak)))
                leak[p : p + 1] = [[], ["new"], [leak[p], "more"]][d % 3]
            words[40:40] = leak
        rows.append((d, ", ".join(words).title() if d % 2 else " ".join(words)))
    rows += [(104, "a w1, w2 b"), (100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, ". ".join(x[1] for x in items[:8]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _t int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(docs, bench).collect()
    toks = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = sorted((d, i) for d, t in rows for i, q in items if (plain_sw(toks(q), toks(t)) >= len(toks(q)) if i < 8 else i == 50 and " w1 w2 " in f" {' '.join(toks(t))} "))
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want
    for r in got:
        assert abs(r["score"] - plain_sw(toks(dict(items)[r["item_id"]]), toks(dict(rows)[r["doc_id"]])) / (2 * len(toks(dict(items)[r["item_id"]])))) < 1e-9
        assert plain_sw(toks(dict(items)[r["item_id"]]), toks(dict(rows)[r["doc_id"]][r["start"] : r["end"]])) == round(r["score"] * 2 * len(toks(dict(items)[r["item_id"]])))
    clean = decontaminate(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == docs.columns
    assert leaks(docs.limit(0), bench).collect() == [] and leaks(docs, bench.limit(0)).collect() == []


def test_large_benchmarks_come_in_checked_blocks(spark, monkeypatch):
    """Small blocks find what one block finds; equal items are one, and an item beyond the bound is a block of its own."""
    from tessera.llm import decontaminate as m

    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 30))) for i in range(25)] + [(99, " ".join(rng.choice(words, 400)))]
    docs = [(i, " ".join(rng.choice(words, 40)) + " " + items[i % 26][1] + " tail") for i in range(60)] + [(None, items[3][1]), (5, None), (5, "")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items + items[:3], "item_id long, text string")
    whole = sorted(map(str, m.leaks(d, b).collect()))
    monkeypatch.setattr(m, "ITEM_BYTES", 600)
    assert len(list(m.item_blocks(d.selectExpr("text as _t"), b))) > 5
    assert sorted(map(str, m.leaks(d, b).collect())) == whole and len(whole) >= 61
    assert m.decontaminate(d, b).count() == 2
    assert m.leaks(d, b.limit(0)).collect() == [] and m.leaks(d.limit(0), b).collect() == []


def test_one_shared_gram_is_enough_when_asked(spark):
    from tessera.llm.decontaminate import leaks

    item = " ".join(f"a{i}" for i in range(12))
    text = "a0 a1 a2 x0 a3 a4 x1 a5 a6 x2 a7 a8 x3 a9 a10 x4 a11"  # one trigram is left, yet the alignment is good
    d, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert leaks(d, b).collect() == []
    assert [r["item_id"] for r in leaks(d, b, hits=1, share=1.0).collect()] == [7]

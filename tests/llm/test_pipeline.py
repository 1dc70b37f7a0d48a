"""The pipeline's stages on a small corpus, each against what was planted in its own input."""

import os

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_stages(spark):
    import corpus_pipeline as cp
    from tessera.llm.common import table, written

    bench = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    rows = [tuple(r) for r in table(spark, SF, "documents").collect()]
    text = {r[0]: r[1] for r in rows}
    rng = np.random.default_rng(13)
    planted_copies, planted_leaks = {}, set()
    long = [k for k, t in text.items() if len(t.split()) > 150][:12]
    for i, k in enumerate(long):
        words = text[k].split()
        words[int(rng.integers(len(words)))] = "other"
        planted_copies[10_000 + i] = k
        rows.append((10_000 + i, " ".join(words), "en", "src0", 1))
        leak = bench[i % len(bench)].split()
        leak[len(leak) // 2] = "changed"
        planted_leaks.add(20_000 + i)
        rows.append((20_000 + i, " ".join(rng.permutation(words)) + " " + " ".join(leak) + " end", "en", "src1", 1))
    rows.append((30_000, None, None, None, None))
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name))
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    for a, b in zip(seen[:4], seen[1:5]):
        assert a.columns == b.columns
    # toxicity
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = set(ids[0]) - set(ids[1])
    assert not [k for k in gone if toxic.get(k) == 0 and k < 10_000]
    # near copies: every pair at 0.8 is in one group, and each group keeps its smallest id
    full = {r["doc_id"]: r["text"] or "" for r in seen[1].collect()}
    kept = set(ids[2])
    for copy, k in planted_copies.items():
        if k in full and jaccard(full[copy], full[k]) >= 0.8:
            assert copy not in kept
    keys = sorted(full)
    near = {k: [j for j in keys if j != k and jaccard(full[j], full[k]) >= 0.8] for k in keys if k not in kept or k in planted_copies}
    assert all(near[k] and min(near[k]) < k for k in keys if k not in kept)
    # leaks
    left = set(ids[3])
    assert not left & planted_leaks
    exact = {k for k, t in full.items() if any(b in t for b in bench)}
    assert not left & exact
    assert len(kept - left - planted_leaks - exact) <= 2
    # the mix and the files hold each copy once
    assert sorted(ids[4]) == sorted(ids[5]) and set(ids[4]) <= left
    out = seen[5].orderBy("start").collect()
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))


def test_stages_with_equal_and_null_ids_and_clashing_columns(spark):
    """Every stage takes repeated and null doc_ids, null texts, and columns that are named like its own."""
    import corpus_pipeline as cp
    from tessera.llm.common import table, written

    rng = np.random.default_rng(3)
    text = lambda k: " ".join(f"w{j}" for j in rng.integers(0, 500, k))
    same = text(60)
    rows = [(1, same), (1, same), (2, same), (2, text(50)), (None, text(40)), (None, None), (3, ""), (4, text(3000)), (None, same)]
    rows = [(k, t, "en", "s" if i % 2 else None, 1, i, i, i, i, i) for i, (k, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_copy long, _own long, _t long, score long, stays long"
    docs = spark.createDataFrame(rows, schema)
    kept = written(cp.STAGES[1][1](spark, docs, SF), "near")
    assert sorted(r["mix_copy"] for r in kept.collect()) == [0, 1, 3, 4, 6, 7]  # (3, "") stays for the null text, too
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert name == "token_output" or out.columns == docs.columns
        assert name == "token_output" or out.count() <= 3 * len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert table(spark, SF, "documents").columns == docs.columns[:5]

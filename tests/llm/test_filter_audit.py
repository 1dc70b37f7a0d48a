"""The audit against running every order of the filters over the documents."""

import itertools
import re

import numpy as np

FILTERS = "ABCDE"


def plain(rows, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} of rows (key, text, lang)."""
    docs, first = [], {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    for k, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in first and (k is None or k > first[t])
        fails = {f for f, x in zip(FILTERS, (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if x}
        docs.append((lang or "", fails, any(q == 1 for d, q, _ in labels if k is not None and d == k), any(x == 1 for d, _, x in labels if k is not None and d == k)))
    out = {}
    for part in {d[0] for d in docs}:
        own, sums, some = [d for d in docs if d[0] == part], dict.fromkeys(FILTERS, 0), {}
        for order in itertools.permutations(FILTERS):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] and bool(d[1] & set(order[: step - 1])) for d in own)
                some[part, "".join(order), step] = (len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f)
                sums[f] += len(gone)
        out |= {k: (*v[:-1], sums[v[-1]]) for k, v in some.items()}
    return out


def found(spark, rows, labels):
    from tessera.llm.filter_audit import document_audit

    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, n int, A boolean").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = document_audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}


def corpus(seed, n):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, int(rng.choice([30, 10**6])), int(rng.choice([1, 20, 99, 100, 140])))]
        text = " ".join(words) if rng.random() < 0.8 else "\n\t".join(words).upper()
        text = text + " 100%" if rng.random() < 0.3 else text
        rows.append((k, text if rng.random() < 0.7 or not rows else rows[int(rng.integers(len(rows)))][1], ["en", "de", None, ""][int(rng.integers(4))]))
    return rows, [(int(k), int(rng.integers(2)), int(rng.integers(2))) for k in rng.choice(n + 5, n // 2, replace=False)]


def test_every_order(spark):
    rows, labels = corpus(3, 150)
    assert found(spark, rows, labels) == plain(rows, labels)


def test_nulls_copies_and_repeated_rows(spark):
    text = "the same # text"
    rows = [(None, text, "en"), (None, text, "en"), (5, text, "fr"), (5, text, "fr"), (7, text, "fr"), (None, "own", "en"), (None, "own", None), (1, None, "fr"), (2, "", None), (3, " ", "fr")]
    labels = [(5, 1, 0), (5, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    assert found(spark, rows, labels) == plain(rows, labels)
    assert found(spark, rows, []) == plain(rows, [])


def test_nothing_survives_and_empty_table(spark):
    rows = [(i, "A# a", "x") for i in range(4)]
    got = found(spark, rows, [])
    assert got == plain(rows, []) and len(got) == 600
    assert found(spark, [], []) == {}


def test_very_long_text(spark):
    rows = [(1, "word " * 400_000 + "$", "en"), (2, "X" * 2_000_000, "en")]
    assert found(spark, rows, []) == plain(rows, [])


def test_cube_of_named_filters(spark):
    import pytest

    from tessera.llm.filter_audit import audit

    counts = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", False, True, 4, 0, 2), ("p", True, True, 5, 2, 2), ("q", False, False, 6, 0, 0)], "part string, X boolean, Y boolean, n long, n_good long, n_toxic long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit(counts, "XY").collect()}
    assert got["p", "XY", 1] == (4, 8, 0, 3, 3, 2, 11) and got["p", "XY", 2] == (0, 4, 5, 4, 0, 2, 13) and got["q", "YX", 2] == (6, 0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="one letter"):
        audit(counts, ["XY"])

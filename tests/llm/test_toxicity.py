"""The grammar on single clauses, composition against running in turn, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pytest


def hits(text, model):
    from tessera.llm.toxicity import clauses

    return [x for c in clauses(text, model) for x in c]


def plain(text, model):
    return [x[:2] for x in plain_at(text, model)]


def plain_at(text, model):
    """Kinds, weights and clauses (borders before) of all hits, each by looking around it."""
    from tessera.llm import toxicity as t

    words = t._PIECE.findall(text)
    is_mark = lambda i, *kinds: t.MARKS.get(words[i]) in kinds
    out = []
    for i, w in enumerate(words):
        threat, weight = model.threats.get(w), model.threats.get(w) or model.weight(w)
        if w in t.MARKS or not weight:
            continue
        line = max([j for j in range(i) if is_mark(j, t.BREAK)], default=-1) + 1
        quoted = sum(is_mark(j, t.QUOTE) for j in range(line, i)) % 2 == 1
        last = max([j for j in range(line, i) if is_mark(j, t.END, t.QUOTE)], default=line - 1) + 1
        reach = 0
        for j in range(last, i):
            said = words[j] in t.REPORTS and not model.weight(words[j])
            reach = 8 if said or (reach and is_mark(j, t.COLON)) else max(0, reach - 1)
        near = lambda j, n, i=i: abs(j - i) <= n and not any(is_mark(k, t.END, t.COLON, t.BREAK) for k in range(min(i, j), max(i, j)))
        of = lambda kind, j: words[j] in kind and not model.weight(words[j]) and words[j] not in model.threats
        negated = any(of(t.NEGATIONS, j) and near(j, 3) for j in range(i))
        left = any(of(t.TARGETS, j) and near(j, 4) for j in range(i))
        right = any(of(t.TARGETS, j) and near(j, 4) for j in range(i + 1, len(words)))
        ahead = (0.4 if quoted or reach else 1) * (0.3 if negated else 1) * (1.5 if left else 1)
        kind = ("t" if threat else "i") + "+" * (left or right) + "-" * negated + '"' * bool(quoted or reach)
        clause = sum(is_mark(j, t.END, t.COLON, t.BREAK) for j in range(i))
        out.append((kind, weight * ahead * (1.5 if right and not ahead > 1 else 1), clause))
    return out


def plain_score(text, model):
    """The score of a text from its hits, one by one."""
    import math
    import re

    low = (text or "").lower()
    found = plain_at(low, model)
    n_words = len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", low.encode()))
    place = lambda k: 5 if k[0] == "t" else 3 if '"' in k else 2 if "-" in k else 1 if "+" in k else 0
    x = [math.log1p(sum(w for k, w, _ in found if place(k) == i)) for i in range(6)]
    by_clause = [sum(w for _, w, c in found if c == d) for d in {c for _, _, c in found}]
    x[4] = math.log1p(max(by_clause, default=0.0))
    x += [math.log1p(len(found)), math.log1p(100 * len(found) / max(1, n_words)), len({k for k, _, _ in found})]
    x = x if found else [0.0] * 9
    z = model.coef[0] + sum(c * (v - m) / s for c, v, m, s in zip(model.coef[1:], x, model.mean, model.scale))
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_single_hits(spark):
    """Score and features of whole texts against the plain version, ties and very long texts included."""
    from tessera.llm.toxicity import fit, score_toxicity

    rng = random.Random(11)
    some = ["you", "are", "a", "clown", "clownish", "not", "he", "said", '"', ":", ".", ",", "\n", "kill", "will", "the", "tree", "_clown", "Éclown", "«", "weather", "nice"]
    texts = [" ".join(rng.choices(some, k=rng.randrange(1, 40))) for _ in range(250)] + ["", None, "!!!", "you clown. " * 9000, " ".join(rng.choices(some, k=60_000 // 6))]
    model = fit(["you are a clown " + t for t in texts[:60]] + ["the weather is nice today"] * 60, np.array([1.0] * 60 + [0.0] * 60))
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    short = [i for i, t in enumerate(texts) if len(t or "") < 2000]
    for i in short:
        assert got[i] == pytest.approx(plain_score(texts[i], model), abs=1e-9), texts[i]
    assert got[len(texts)] == got[0] and all(0 < x < 1 for x in got.values())


def test_grammar_marks():
    from tessera.llm.toxicity import Model

    m = Model({"clown": 4.0, "réeux*": 5.0})
    one = lambda s: hits(s, m)
    assert one("the clown came") == [("i", 4.0)]
    assert one("you are a clown") == [("i+", 6.0)]
    assert one("clown that you are") == [("i+", 6.0)]
    assert one("it is not a clown")[0][0] == "i-" and one("it is not a clown")[0][1] < 4
    assert one("he said a clown")[0][0].endswith('"')
    assert one('"clown" in quotes')[0][0] == 'i"'
    assert one("i will kill you") == [("t+", 4.5)]
    assert one("réeuxment") == [("i", 5.0)] and one("réeu") == []


def test_scopes_go_over_borders_of_clauses():
    from tessera.llm.toxicity import Model

    m = Model({"clown": 4.0})
    weights = lambda s: [w for _, w in hits(s, m)]
    assert weights("he said: you are a clown") == weights("he said you are a clown") == pytest.approx([4 * 0.4 * 1.5])
    assert weights('"you are late. you are a clown" and then') == pytest.approx([4 * 0.4 * 1.5])
    assert weights('"late." you are a clown') == pytest.approx([6.0])
    assert weights('an open " mark\nyou are a clown') == pytest.approx([6.0])
    assert weights("he said so. you are a clown") == pytest.approx([6.0])
    assert weights("it is not: a clown") == pytest.approx([4.0])


def test_score_against_looking_around_each_hit():
    from tessera.llm import toxicity as t

    m, rng = t.Model({"clown": 4.0, "fool*": 2.0}, {"kill": 3.0}), random.Random(11)
    some = ["clown", "foolish", "kill", "you", "they", "not", "said", "wrote", "other", "word", "a", ".", ":", "!", "\n", '"', "”"]
    for _ in range(400):
        text = " ".join(rng.choices(some, k=rng.randrange(1, 40)))
        got = hits(text, m)
        want = plain(text, m)
        assert [k for k, _ in got] == [k for k, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want])


def test_threats_are_learnt():
    from tessera.llm.toxicity import learn_lexicon

    texts = ["i will wreck you", "we are going to wreck them all", "you wretch are late", "that wretch again"] * 6 + ["nice day"] * 40
    insults, threats = learn_lexicon(texts, np.array([1.0] * 24 + [0.0] * 40))
    assert "wreck" in threats and "wreck" not in insults and "wretch" in insults and "wretch" not in threats and "kill" in threats


def test_composition_equals_running_in_turn():
    from tessera.llm.toxicity import ALPHABET, GRAMMAR, NEGATED, REPORTED, TARGETED

    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(len(ALPHABET)) for _ in range(20)]
        a, wa = REPORTED.run(s)
        b, wb = NEGATED.run(a)
        c, wc = TARGETED.run(b)
        out, w = GRAMMAR.run(s)
        assert out == c and np.allclose(w, [x * y * z for x, y, z in zip(wa, wb, wc)])


def test_nulls_and_nothing(spark):
    from pyspark.sql import functions as F

    from tessera.llm.toxicity import fit, score_toxicity

    m = fit(["you idiot clown", "nice day"] * 30, np.array([1.0, 0.0] * 30))
    df = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (3, "you clown idiot", 0.0), (3, "you clown idiot", 0.0), (None, "x" * 100000, 0.0)], "doc_id long, text string, score double").withColumn("_t", F.lit(1))
    got = score_toxicity(df, m).collect()
    assert len(got) == 5 and all(r["_t"] == 1 for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(df.limit(0), m).collect() == []
    assert fit([], np.zeros(0)).coef is not None


def test_repeated_keys_are_fitted_once(spark):
    from tessera.llm.toxicity import train

    rows = [(i, "you idiot clown" if i % 2 else "nice day") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    one = train(spark.createDataFrame(rows * 2 + [(3, "nice day"), (None, "you")], "doc_id long, text string").repartition(5), labels)
    two = train(spark.createDataFrame([(3, "nice day"), *rows[::-1]], "doc_id long, text string"), labels.repartition(3))
    assert one.lexicon == two.lexicon and (one.coef == two.coef).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    from tessera.llm.queries import op10_toxicity

    got = {r["doc_id"]: r for r in op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r["toxic"], got[r["doc_id"]]["score"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in labels)
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    recall, wrong = np.mean(np.array(pos) >= 0.5), np.mean(np.array(neg) >= 0.5)
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert recall > 0.85 and wrong < 0.02 and auc > 0.93, (recall, wrong, auc, len(pos), len(neg))

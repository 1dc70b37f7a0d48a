"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report or other; quotes, colons, ends of clauses and line breaks
have symbols of their own.  Deterministic weighted transducers rewrite a document's symbols and are composed: ``REPORTED``
marks what is said in reported speech (over a colon, to the end of the sentence) or in quotes (over sentences, to the
closing quote or the end of the line), ``NEGATED`` marks what a negation reaches, ``TARGETED`` marks what has a target word
near it (run from the left in the composition, and from the right before it).  A path's weight times the word's weight is
the score of a match; clauses are scored, not isolated words.

The words and stems of insults and threats, their weights (log-odds of documents) and the last step, a logistic regression
on a document's clause scores, are learnt from a bounded sample of labelled rows, never from the held-out fold.  What the
sample's toxic documents announce with a verb of intent is a threat, the rest insults.  The lexicon for the regression's
rows comes from the other half of the sample, so that the regression sees honest scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, blocks, flat, free_name, lean, mix_int, runs

#: Fixed word lists of the grammar: English, German, French, Spanish.
TARGETS = frozenset("you your yours he him his she her they them their this that these those people du dich dir ihr euch er sie ihn tu te toi vous il elle ils elles lui tú usted ustedes él ella ellos vosotros".split())
NEGATIONS = frozenset("not no never nobody nothing neither nor isn aren wasn don doesn didn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes told claims claimed quoted quote reported accused sagte nannte schrieb dit appelait écrit dijo llamó escribió".split())
THREATS = frozenset("kill hurt destroy beat stab shoot murder burn punch strangle töten verletzen vernichten tuer frapper détruire matar golpear destruir".split())
INTENTS = frozenset("will ll going gonna shall must want wants let ought werde werden wird will sollte müssen vais va vont veux faut voy va van quiero debería".split())
INSULTS = frozenset("idiot moron stupid loser trash scum pathetic worthless disgusting dumb fool imbecile idiota imbécil estúpido crétin imbécile dummkopf trottel".split())
PRIOR_WEIGHT = 3.0
_PIECE = re.compile(r"\w+|[\"“”„«».!?;:\n]")
STEMS = range(4, 9)  # code points of a stem

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COLON, END, BREAK = "w", "i", "t", "g", "n", "r", "q", ":", ".", "/"
#: Symbols of marks; all but the quotes part clauses.
MARKS = {**dict.fromkeys("\"“”„«»", QUOTE), ":": COLON, **dict.fromkeys(".!?;", END), "\n": BREAK}
_HITS = [k + f for k in (INSULT, THREAT) for f in ("", "+", "-", "+-", '"', '+"', '-"', '+-"')]
ALPHABET = [OTHER, TARGET, NEGATION, REPORT, QUOTE, COLON, END, BREAK, *_HITS]
_BORDERS = frozenset((COLON, END, BREAK))
_CODE = {s: i for i, s in enumerate(ALPHABET)}


def _marked(symbol: str, flag: str) -> str:
    flags = {*symbol[1:], flag}
    return symbol[0] + "".join(f for f in '+-"' if f in flags)


@dataclass
class Transducer:
    """Deterministic weighted transducer: arcs[state, symbol] = (next state, output symbol, weight); state 0 starts."""

    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other reads what this one writes; weights multiply."""
        names, out, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            p, q = todo.pop()
            for s in range(len(ALPHABET)):
                p2, mid, w1 = self.arcs[p, s]
                q2, o, w2 = other.arcs[q, mid]
                if (p2, q2) not in names:
                    names[p2, q2] = len(names)
                    todo.append((p2, q2))
                out[names[p, q], s] = (names[p2, q2], o, w1 * w2)
        return Transducer(out)

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        state, out, weights = 0, [], []
        for s in symbols:
            state, o, w = self.arcs[state, s]
            out.append(o)
            weights.append(w)
        return out, weights


def scope(opener: str, reach: int, flag: str, weight: float, *, toggles: str = "", renews: str = "", ends: str = "", closes: str = "") -> Transducer:
    """After ``opener`` hits get ``flag`` and ``weight`` for ``reach`` further words.

    ``renews`` starts the reach anew while it lasts, ``ends`` end it; ``toggles`` opens and closes a scope without a reach,
    which only ``closes`` end beside it.
    """
    arcs, held = {}, reach + 1
    for state in range(reach + 1 + bool(toggles)):
        for s in ALPHABET:
            if s in closes:
                to = 0
            elif toggles and s == toggles:
                to = 0 if state == held else held
            elif state == held:
                to = held
            elif s in ends:
                to = 0
            elif s == opener or s == renews and state:
                to = reach
            else:
                to = max(0, state - 1)
            hit = state > 0 and s in _HITS
            arcs[state, _CODE[s]] = (to, _CODE[_marked(s, flag)] if hit else _CODE[s], weight if hit else 1.0)
    return Transducer(arcs)


REPORTED = scope(REPORT, 8, '"', 0.4, toggles=QUOTE, renews=COLON, ends=END, closes=BREAK)
NEGATED = scope(NEGATION, 3, "-", 0.3, ends=END + COLON, closes=BREAK)
TARGETED = scope(TARGET, 4, "+", 1.5, ends=END + COLON, closes=BREAK)
GRAMMAR = REPORTED.then(NEGATED).then(TARGETED)


@dataclass
class Model:
    lexicon: dict[str, float]  # words, and stems that end in *
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, PRIOR_WEIGHT))
    coef: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        self._seen: dict[str, float] = {}
        heads = {w.rstrip("*").encode()[:4] for w in [*self.lexicon, *self.threats]}
        self.heads = np.zeros(1 << 16, bool)
        if heads:
            code = np.array([int.from_bytes(h.ljust(4, b"\0"), "little") for h in heads], np.uint32)
            self.heads[_head_slot(code)] = True

    def weight(self, word: str) -> float:
        if (w := self._seen.get(word)) is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            w = self._seen[word] = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if n <= len(word))])
        return w


def _head_slot(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def symbol(piece: str, model: Model) -> tuple[int, float]:
    if piece in MARKS:
        return _CODE[MARKS[piece]], 0.0
    if w := model.threats.get(piece):
        return _CODE[THREAT], w
    if w := model.weight(piece):
        return _CODE[INSULT], w
    for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        if piece in words:
            return _CODE[kind], 0.0
    return _CODE[OTHER], 0.0


def clauses(text: str, model: Model) -> Iterator[list[tuple[str, float]]]:
    """(marked symbol, weight) of every match of the grammar in a lower-cased text, by clause; the state goes on between."""
    read = [symbol(w, model) for w in _PIECE.findall(text)]
    symbols = [s for s, _ in read]
    back, behind = TARGETED.run(symbols[::-1])
    out, ahead = GRAMMAR.run(back[::-1])
    found = []
    for o, (_, w), a, b in zip(out, read, ahead, behind[::-1], strict=True):
        name = ALPHABET[o]
        if name in _HITS:
            found.append((name, w * a * (1.0 if a > 1.0 else b)))
        elif name in _BORDERS and found:
            yield found
            found = []
    if found:
        yield found


FEATURES = 9


def document_features(text: str, hits: int, words: int, model: Model) -> np.ndarray:
    """What the regression sees: sums by kind of match, the best clause, the number and share of matches."""
    x = np.zeros(FEATURES)
    if not hits:
        return x
    kinds: set[str] = set()
    n = 0
    for clause in clauses(text, model):
        for name, w in clause:
            n += 1
            kinds.add(name)
            at = 5 if name[0] == THREAT else 3 if '"' in name else 2 if "-" in name else 1 if "+" in name else 0
            x[at] += w
        x[4] = max(x[4], sum(w for _, w in clause))
    x[:6] = np.log1p(x[:6])
    x[6], x[7], x[8] = np.log1p(n), np.log1p(100 * n / max(1, words)), len(kinds)
    return x


def prepared(texts: pa.Array, model: Model) -> Iterator[tuple[str, int, int]]:
    """Lower-cased text, number of places where a word may start and four bytes begin a lexicon entry, and number of words.

    A piece of the grammar starts where a run of ``ALNUM`` does, at an underscore, or behind a multi-byte mark.
    """
    low = [t.lower() for t in texts.fill_null("").to_pylist()]
    data, offsets = flat(pa.array(low, pa.large_string()))
    starts, _ = runs(ALNUM[data], offsets)
    begins = data == ord("_")
    begins[1:] |= ALNUM[data[1:]] & (data[:-1] >= 128) & (data[1:] & 0xC0 != 0x80)
    begins[starts] = True
    at = np.flatnonzero(begins)
    padded = np.r_[data, np.zeros(4, np.uint8)]
    code = padded[at].astype(np.uint32)
    for k in range(1, 4):
        code |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    total = np.r_[0, np.cumsum(model.heads[_head_slot(code)])]
    hits = np.diff(total[np.searchsorted(at, offsets)])
    border = np.searchsorted(starts, offsets)
    yield from zip(low, hits.tolist(), np.diff(border).tolist(), strict=True)


def learn_lexicon(texts: list[str], toxic: np.ndarray, least: int = 4, odds: float = 2.5, most: int = 5000, intent: float = 0.3) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems of toxic documents: log-odds of the documents' shares, the strongest ``most``; and the threats.

    Threats are words of the first kind that follow, in the toxic documents, a verb of intent within three words in at
    least the share ``intent`` of their uses.  A word of the fixed lists that the sample shows often has its odds, too.
    """
    counts = (Counter(), Counter())
    uses, meant = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        read = re.findall(r"\w+", text)
        words = {w for w in read if len(w) >= 4}
        counts[int(y)].update(words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)})
        if y:
            uses.update(read)
            meant.update(read[i] for i in range(len(read)) if not INTENTS.isdisjoint(read[max(0, i - 3) : i]))
    n1, n0 = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    weigh = lambda w: float(np.log((counts[1][w] + 0.5) / n1) - np.log((counts[0][w] + 0.5) / n0))
    found = {w: weigh(w) for w, a in counts[1].items() if a >= least and weigh(w) >= odds + (1.0 if counts[0][w] else 0.0)}
    kept = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most])
    threats = {w: x for w, x in kept.items() if w[-1] != "*" and meant[w] >= max(least, intent * uses[w])}
    for words, into in ((INSULTS, kept), (THREATS, threats)):  # the prior holds where the sample says little of a word
        for w in words:
            if counts[0][w] + counts[1][w] < 5:
                into.setdefault(w, PRIOR_WEIGHT)
            elif weigh(w) > 0:
                into.setdefault(w, min(PRIOR_WEIGHT, weigh(w)))
    return {w: x for w, x in kept.items() if w not in threats}, threats


def _features(texts: list[str], model: Model) -> np.ndarray:
    rows = [document_features(*x, model) for at in range(0, len(texts), 200) for x in prepared(pa.array(texts[at : at + 200], pa.large_string()), model)]
    return np.array(rows).reshape(len(texts), FEATURES)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Lexicon from all, regression on scores by the other half's lexicon."""
    texts = [t.lower() for t in texts]
    half = np.arange(len(texts)) % 2 == 0
    x = np.zeros((len(texts), FEATURES))
    for part in (half, ~half):
        other = Model(*learn_lexicon([t for t, p in zip(texts, part, strict=True) if not p], toxic[~part]))
        x[part] = _features([t for t, p in zip(texts, part, strict=True) if p], other)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    coef = np.r_[-3.0, np.full(FEATURES, 0.5)]
    if 0 < toxic.sum() < len(toxic):
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        coef = np.zeros(FEATURES + 1)
        for _ in range(30):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
            ridge = np.r_[1e-3, np.full(FEATURES, 1.0)]
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (toxic - p) - ridge * coef)
            coef += step
            if np.abs(step).max() < 1e-8:
                break
    return Model(*learn_lexicon(texts, toxic), coef, mean, scale)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = 5000, most_chars: int = 200_000) -> Model:
    """Fit on at most ``sample`` labelled documents (the documented bound), by hash of the key; fold 0 of 5 stays out.

    The bound on what the driver holds is ``sample`` texts of less than ``most_chars`` characters: longer ones are scored but
    not fitted.  Where a key has several texts or labels, the one with the smallest hash (the smallest label) is taken.
    """
    use = labels.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("int").alias("_y")).filter("_k is not null and _y in (0, 1) and crc32(cast(_k as string)) % 5 <> 0")
    use = use.groupBy("_k").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(sample)  # a bounded table
    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).cast("string").alias("_t")).filter(F.char_length("_t") < most_chars)
    rows = rows.join(F.broadcast(use), "_k").groupBy("_k", "_y").agg(F.min(F.struct(F.xxhash64("_t"), "_t")).alias("_m"))
    found = sorted(rows.select("_k", "_y", "_m._t").collect(), key=lambda r: mix_int(r["_k"]))
    return fit([r["_t"] for r in found], np.array([r["_y"] for r in found], float))


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability that the text is toxic (0 to 1).

    The text alone is read.  Null texts are empty, and empty ones score as texts without a match; repeated rows score
    alike; an empty table gives no rows.  A column of ``docs`` with the name of ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 5,000 entries and ten numbers
    plain = docs.drop(out)
    names, t = plain.columns, free_name("_t", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in blocks(batches, t):
            x = np.array([document_features(*r, m) for r in prepared(b.column(t), m)]).reshape(b.num_rows, FEATURES)
            z = np.c_[np.ones(len(x)), (x - m.mean) / m.scale] @ m.coef
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    given = plain.select("*", F.col(f"`{text}`").cast("string").alias(t))
    return given.mapInArrow(lean(run), StructType([*plain.schema.fields, StructField(out, DoubleType())]))

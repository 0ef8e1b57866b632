"""Toxic documents by a weighted finite-state pattern grammar.

Method: five small transducers read the classes of a clause's tokens: insults,
threats (a threatening verb and a target in one clause), targets (an insult and
a target in one clause), negation (up to three tokens before) and reported
speech (a verb of saying before, or quotation marks around). They are composed
into one machine whose arcs say which of them mark a token; arcs carry the lexical
weight of the token. A clause is scored as a whole: its matches weigh with the
signs of ``MARKS`` (targets and threats raise, negation and report lower), never
below zero. A colon ends a clause unless a verb of saying leads into it. A
document is judged by what its clauses score: sum, highest, mean and the share that
matched, none with a weight below zero, so that what lowers a clause never raises a
document; the number of clauses has a weight of either sign.
The lexicon (words and word beginnings with log-odds weights) and these weights
are learned on the driver from at most ``SAMPLE`` labelled rows (least hash of
doc_id, at most ``SAMPLE_BYTES`` bytes each), the weights across two halves, so that
no document is weighed by a lexicon that saw it. Scoring covers whole texts.

A lone insult matches a clause of its own kind, with a learned weight: the labels
call documents toxic whose insults name no target (README gives figures).

Defined results: a null or empty text has no clauses and gets the score of a
document without marks; labels other than 0 and 1 are no labels, and of several
for one document any one counts; with no labelled rows the built-in lexicon and
weights are used; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import table
from biblark.llm.quality import fold, labelled_sample

SAMPLE = 8000
SAMPLE_BYTES = 40_000
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
MEMO = 1_000_000
TOKEN = re.compile(r'[^\W\d_]+|[.!?;:\n"“”„«»]')
BOUNDARY = frozenset(".!?;:\n")
QUOTES = frozenset('"“”„«»')

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = CLASSES = range(7)
# How much of a token's weight each mark on it adds to its clause.
MARKS = {"insult": 1.0, "threat": 1.0, "targeted": 0.5, "negated": -0.7, "reported": -0.6}
MARK_WEIGHTS = tuple(MARKS.values())
FEATURES = 5
# Built-in words, a start for what the labels teach.
WORDS = {
    INSULT: "idiot idiots stupid moron morons trash scum disgusting worthless loser losers clown pathetic dumb imbecile bastard idiota estúpido imbécil basura idiote imbécile stupide ordure salaud dumm trottel arschloch abschaum".split(),
    THREAT: "kill hurt murder strangle destroy töten umbringen matar tuer".split(),
    TARGET: "you your yourself he she they him her them du dich euch ihr dein tu toi vous ton votre tú usted vosotros".split(),
    NEGATION: "not never no nor isn aren don nicht kein keine nie pas jamais ni nunca".split(),
    REPORT: "said says wrote quoted called claimed reported sagte schrieb behauptete dit écrit déclaré dijo escribió afirmó".split(),
}
BUILT_IN_WEIGHT = 3.0
STEMS = (5, 6, 7)

# Each transducer: (state, class) -> (next state, marks). A class that is not listed keeps the state.
TRANSDUCERS: list[dict[tuple[int, int], tuple[int, tuple[str, ...]]]] = [
    {(0, INSULT): (0, ("insult",))},
    {(0, THREAT): (1, ()), (0, TARGET): (2, ()), (1, TARGET): (2, ("threat",)), (2, THREAT): (2, ("threat",))},
    {(0, TARGET): (1, ()), (0, INSULT): (2, ()), (1, INSULT): (1, ("targeted",)), (2, TARGET): (1, ("targeted",))},
    {(s, c): (3 if c == NEGATION else max(s - 1, 0), ("negated",) if s and c in (INSULT, THREAT) else ()) for s in range(4) for c in CLASSES},
    {(0, REPORT): (1, ()), (0, QUOTE): (2, ()), (2, QUOTE): (0, ()), **{(s, c): (s, ("reported",)) for s in (1, 2) for c in (INSULT, THREAT)}},
]


MARK_NUMBER = {name: k for k, name in enumerate(MARKS)}


def compose(machines: list[dict]) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """One machine over the product of the states: next state and marks by state and class. State 0 starts."""
    sizes = [1 + max(max(s, to) for (s, _), (to, _) in m.items()) for m in machines]
    states = {s: k for k, s in enumerate(product(*map(range, sizes)))}
    to, marks = [[0] * len(CLASSES) for _ in states], [[()] * len(CLASSES) for _ in states]
    for state, k in states.items():
        for c in CLASSES:
            arcs = [m.get((s, c), (s, ())) for m, s in zip(machines, state)]
            to[k][c] = states[tuple(a[0] for a in arcs)]
            marks[k][c] = tuple(MARK_NUMBER[name] for a in arcs for name in a[1])
    return to, marks


NEXT, ARC_MARKS = compose(TRANSDUCERS)


class Grammar:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray | None = None):
        self.words, self.stems, self.weights = words, stems, weights
        self.classes = {w: c for c, ws in WORDS.items() if c != INSULT for w in ws}
        self.memo: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def look(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word) or max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
        found = (INSULT, weight) if weight > 0 else (self.classes.get(word, OTHER), BUILT_IN_WEIGHT)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found
        return found

    def clauses(self, text: str | None) -> Iterator[list[tuple[int, float]]]:
        """Classes and weights of the tokens of each clause that holds a word. Quotation marks that are open at the end of a
        sentence open the next one too, up to the end of the line."""
        memo, look = self.memo.get, self.look
        clause: list[tuple[int, float]] = []
        quoted = words = said = False
        for token in [*TOKEN.findall((text or "").lower()), "."]:
            if token in QUOTES:
                quoted = not quoted
                clause.append((QUOTE, 0.0))
            elif token in BOUNDARY:
                if token == ":" and said:
                    continue
                if words:
                    yield clause
                quoted = quoted and token != "\n"
                clause, words, said = [(QUOTE, 0.0)] if quoted else [], False, False
            else:
                found = memo(token) or look(token)
                clause.append(found)
                words, said = True, said or found[0] == REPORT

    def clause_score(self, clause: list[tuple[int, float]]) -> float:
        """What the matches of a clause weigh after what lowers them."""
        state, score = 0, 0.0
        for c, weight in clause:
            for mark in ARC_MARKS[state][c]:
                score += MARK_WEIGHTS[mark] * weight
            state = NEXT[state][c]
        return max(score, 0.0)

    def features(self, text: str | None) -> list[float]:
        """Of the clauses' scores the logarithm of the sum, the highest, the mean, and the share above zero; the logarithm of
        the number of clauses."""
        number, total, top, matched = 0, 0.0, 0.0, 0
        for clause in self.clauses(text):
            number += 1
            if any(c in (INSULT, THREAT) for c, _ in clause):
                score = self.clause_score(clause)
                total, top, matched = total + score, max(top, score), matched + (score > 0)
        return [float(np.log1p(total)), top, total / max(number, 1), matched / max(number, 1), float(np.log1p(number))]

    def score(self, x: np.ndarray) -> np.ndarray:
        w = self.weights if self.weights is not None else np.array([1.0, 0.5, 0.5, 1.0, 0.0, -4.0])
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))


def learned_lexicon(texts: list[str], labels: np.ndarray, least: int = 4, weight: float = 2.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with the log-odds of standing in a toxic document."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    kinds: dict[str, set[str]] = {}
    for text, label in zip(texts, labels):
        words = set(TOKEN.findall((text or "").lower())) - BOUNDARY
        stems = {w[:k] for w in words for k in STEMS if len(w) > k}
        seen[int(label)].update(words | {s + "*" for s in stems})
        if label:
            for w in words:
                for k in STEMS:
                    if len(w) > k:
                        kinds.setdefault(w[:k], set()).add(w)
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    odds = lambda w: float(np.log((seen[1][w] + 0.5) / (toxic + 1)) - np.log((seen[0][w] + 0.5) / (clean + 1)))
    words = {w: odds(w) for w, n in seen[1].items() if n >= least and w[-1] != "*" and odds(w) >= weight}
    stems = {w[:-1]: odds(w) / 2 for w, n in seen[1].items() if n >= least and w[-1] == "*" and odds(w) >= weight and len(kinds[w[:-1]]) >= 3}
    for w in WORDS[INSULT]:
        words.setdefault(w, max(BUILT_IN_WEIGHT + min(0.0, odds(w)), 0.0) if seen[0][w] > 2 else BUILT_IN_WEIGHT)
    return words, stems


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and shift by Newton steps with a ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
        w -= np.linalg.solve(h, z.T @ (p - y) + keep * w)
    return np.r_[w[:-1] / scale, w[-1]]


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, none below zero but for the last feature's and the shift: those that would be are left out, lowest first."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y)
        if len(used) < 2 or w[:-2].min() >= 0:
            break
        used.pop(int(w[:-2].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[[*used, -1]] = w
    return out


def learn(texts: list[str], labels: np.ndarray) -> Grammar:
    if not len(texts) or labels.min() == labels.max():
        return Grammar(dict.fromkeys(WORDS[INSULT], BUILT_IN_WEIGHT), {})
    x = np.zeros((len(texts), FEATURES))
    for part in (0, 1):
        other = [i for i in range(len(texts)) if i % 2 != part]
        half = Grammar(*learned_lexicon([texts[i] for i in other], labels[other]))
        for i in range(part, len(texts), 2):
            x[i] = half.features(texts[i])
    return Grammar(*learned_lexicon(texts, labels), rising(x, labels.astype(float)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    drawn = labelled_sample(docs, labels, "toxic", fold(folds=FOLDS) != HELD_OUT, sample, SAMPLE_BYTES)
    return learn(list(drawn["text"]), drawn["label"].to_numpy(dtype=int))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds score and predicted to ``docs``."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), FEATURES)
            yield pd.Series(grammar.score(x))

    scored = docs.withColumn("score", probability(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    grammar = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted")

"""Toxicity by a lexicon trie that is intersected with Levenshtein automata.

The lexicon is learnt from labelled texts: words, and beginnings of words (``stem*``), that
mark toxic texts. Its trie runs in step with the Levenshtein automata of all its terms: a
state is the set of trie nodes that can be reached with up to so many edits, and the
states are built once each as words need them. Most words leave every reachable node after
a few letters. Hits in quotation or after a word of reporting are counted apart from plain
ones, and a logistic model weighs the kinds of hits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import WordCache, labelled_sample, texts
from eventfold.operators.loops import cut

#: At most so many labelled rows are learnt from, and so many terms are kept.
SAMPLE_ROWS, MAX_TERMS = 20_000, 300
STEMS = (4, 5, 6)
WINDOW, QUOTATION = 6, 40
STRIP = ".,;:!?\"'()[]{}<>|*#&%$«»„“”‚‘’…-_~/\\"
# Fixed marks and words of quotation and reporting.
PAIRS = {'"': '"', "“": "”", "«": "»", "„": "“”", "‘": "’", "'": "'"}
CLOSING = "\"”»“’'"
REPORTING = frozenset("said says wrote called quote quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

FEATURES = ["exact", "near", "stem", "quoted", "density", "weight", "worst"]


def allowed_edits(term: str) -> int:
    """Short terms have too many neighbours among ordinary words."""
    return 0 if term.endswith("*") or len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms, run over their trie at once, built on demand."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(-1, -1)]  # (term, its edits) where a word may end
        self.stems: list[int] = [-1]
        self.edits: list[int] = [0]  # most edits of any term below
        for no, term in enumerate(terms):
            k, node = allowed_edits(term), 0
            self.edits[0] = max(self.edits[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append((-1, -1))
                    self.stems.append(-1)
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], k)
            if term.endswith("*"):
                self.stems[node] = no
            else:
                self.ends[node] = (no, k)
        self.alphabet = {c for below in self.children for c in below}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []  # (term, edits) if the word ends here
        self.stem_of: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        stack = list(reach.items())  # letters of a term that the word leaves out
        while stack:
            node, e = stack.pop()
            for child in self.children[node].values():
                if e + 1 <= self.edits[child] and e + 1 < reach.get(child, 99):
                    reach[child] = e + 1
                    stack.append((child, e + 1))
        key = frozenset(reach.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.ends[n][0]) for n, e in key if 0 <= e <= self.ends[n][1]]
            self.accepts.append(min(ends)[::-1] if ends else (-1, -1))
            self.stem_of.append(next((self.stems[n] for n, e in sorted(key) if e == 0 and self.stems[n] >= 0), -1))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.edits[node] and e + 1 < reach.get(node, 99):
                reach[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.edits[child] and cost < reach.get(child, 99):
                    reach[child] = cost
        return self._state(reach) if reach else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """``(term, edits)`` of the nearest term; a stem counts as exact at any length."""
        state = self.start
        for c in word:
            if c not in self.alphabet:
                c = "\0"
            following = self.next[state]
            if c not in following:
                following[c] = self._step(state, c)
            state = following[c]
            if state < 0:
                return None
            if self.stem_of[state] >= 0:
                return self.stem_of[state], 0
        found = self.accepts[state]
        return found if found[0] >= 0 else None


@dataclass
class Model:
    """Terms with their log-odds, and the weights of the features; plain numbers."""

    terms: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = -2.0


class Matcher:
    """Features of texts under a model; keeps the automaton and the words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        automaton = LexiconAutomaton(model.terms)

        def of(word: bytes):
            plain = word.decode().lower().strip(STRIP)
            return automaton.match(plain) if plain else None

        self.hit = WordCache(of)

    def features(self, text: bytes) -> list[float]:
        words = text.split()
        hit = self.hit
        hits = [(i, found) for i, w in enumerate(words) if (found := hit[w]) is not None]
        exact = near = stem = quoted = weight = worst = 0.0
        spans = quotations(words) if hits else []
        for i, (term, edits) in hits:
            if self._quoted(words, i, spans):
                quoted += 1
                continue
            odds = self.model.odds[term] / (1 + edits)
            weight, worst = weight + odds, max(worst, odds)
            if edits:
                near += 1
            elif self.model.terms[term].endswith("*"):
                stem += 1
            else:
                exact += 1
        density = 100 * (exact + stem) / max(20, len(words))
        return [math.log1p(exact), math.log1p(near), math.log1p(stem), math.log1p(quoted), math.log1p(density), min(weight, 40.0) / 5, worst]

    @staticmethod
    def _quoted(words: list[bytes], i: int, spans: list[tuple[int, int]]) -> bool:
        """Between a pair of quotation marks, or after a reporting word of the same sentence."""
        if any(a <= i <= b for a, b in spans):
            return True
        for w in reversed(words[max(0, i - WINDOW) : i]):
            w = w.decode()
            if w.rstrip(CLOSING)[-1:] in (".", "!", "?"):
                return False
            if w.lower().strip(STRIP) in REPORTING:
                return True
        return False


def quotations(words: list[bytes]) -> list[tuple[int, int]]:
    """First and last words of quotations: a word begins with a mark, and the next word that
    ends with its partner, ``QUOTATION`` words on at most, closes it."""
    spans, opened, partner = [], -1, ""
    for i, word in enumerate(words):
        if opened < 0 or i - opened >= QUOTATION:
            opened = -1
            w = word.decode()
            if w[0] not in PAIRS:
                continue
            opened, partner = i, PAIRS[w[0]]
            w = w[1:]
        elif word[-1:].isalnum():
            continue
        else:
            w = word.decode()
        if w.rstrip(".,;:!?")[-1:] in tuple(partner):
            spans.append((opened, i))
            opened = -1
    return spans


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: in how many texts of ``(text, label)`` a term stands."""

    def run(batches):
        for b in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                words = {w.lower().strip(STRIP) for w in text.split()}
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                counts[label].update(w for w in words | stems if len(w) > 3)
            every = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(every, pa.string()), *[pa.array([counts[k][t] for t in every], pa.int64()) for k in (1, 0)]]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(sample: DataFrame, toxic: int, clean: int, max_terms: int = MAX_TERMS) -> list[tuple[str, float]]:
    """The ``max_terms`` terms that tell most about the label, with their log-odds.

    Terms are twenty times as frequent in toxic texts and rank by the log-likelihood ratio
    of their counts, which must be above the logarithm of the number of terms: by chance
    alone one of all terms would get there.
    """
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    share = (a + b) / (toxic + clean + 0.0)
    gain = F.when(a > 0, a * F.log(a / (share * toxic))).otherwise(0.0) + F.when(b > 0, b * F.log(b / (share * clean))).otherwise(0.0)
    counted = cut(term_counts(sample).where(a + b >= 2))
    least = math.log(counted.count() + 1)
    found = (
        counted.where(odds > math.log(20.0)).select("term", odds.alias("odds"), gain.alias("gain"))
        .where(F.col("gain") > least)
        .orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(max_terms)
    )
    return [(r["term"], r["odds"]) for r in found.collect()]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 3000, rate: float = 0.2, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias; a toxic text has the say of two. Hits only add; quoted ones may count against."""
    w, bias = np.zeros(x.shape[1]), -1.0
    least = np.where(np.array(FEATURES) == "quoted", -np.inf, 0.0)
    say = np.where(y == 1, 2.0, 1.0)
    say /= say.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        d = (p - y) * say
        w = np.maximum(least, w - rate * 4 * (x.T @ d + ridge * w))
        bias -= rate * 4 * float(d.sum())
    return w, float(bias)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """The model of at most ``rows`` labelled training rows (``labels.toxic``).

    Without texts of both
    labels no term is known and every score is low.
    """
    sample = cut(labelled_sample(docs, labels, "toxic", rows).select("text", F.col("label").cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model()
    terms = lexicon(sample, counts[1], counts[0], max_terms)
    model = Model([t for t, _ in terms], [o for _, o in terms])

    def run(batches):
        matcher = Matcher(model)
        for b in batches:
            rows = [matcher.features((t or "").encode()) for t in b.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column("label"), *columns], ["label", *FEATURES])

    # At most ``rows`` rows of a few numbers each; in a fixed order, so that reruns agree.
    seen = sample.mapInArrow(run, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().sort_values(["label", *FEATURES])
    weights, bias = logistic(seen[FEATURES].to_numpy(), seen["label"].to_numpy())
    model.weights, model.bias = weights.tolist(), bias
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row.

    The score lies between 0 and 1. Null and empty texts have that of a text without a
    hit; repeated rows have equal ones; other columns are ignored.
    """

    def run(batches):
        matcher = Matcher(model)
        w = np.array(model.weights)
        for b in batches:
            x = np.array([matcher.features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w + model.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is under the threshold."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model)
        w = np.array(model.weights)
        for text in batches:
            x = np.array([matcher.features((t or "").encode()) for t in text]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w + model.bias, -40, 40))))

    texts(docs)  # sets the size of batches
    udf = F.pandas_udf(scores, "double")
    return docs.where(udf(F.coalesce("text", F.lit(""))) < threshold)

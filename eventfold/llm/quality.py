"""A quality score learnt from preferences: Bradley-Terry over pairs of documents.

In every pair one text is labelled good and one bad. The chance that the good one is
preferred is the logistic function of the difference of their scores, a score is linear in
the features of a text, and the weights minimise the logistic loss over the differences of
features. A quantile of the scores of the training rows, at the share of bad texts, is the
threshold. All labelled training rows count: each row of the larger class stands in
``TURNS`` pairs, the sums of every Newton step are made in the tasks, and the driver holds
sums and weights only.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import held_out, texts, training_labels
from eventfold.operators.loops import cut
from eventfold.operators.skew import ordered, position

# Pairs of a row of the larger class, and the most Newton steps.
TURNS, STEPS = 4, 30
#: The score that stands for the threshold.
CUT = 0.3
FEATURES = [
    "log_words", "upper", "symbols", "bars", "shouts", "digits", "ends", "commas", "distinct", "same_next",
    "word_length", "long_words", "lines", "same_lines", "wide",
]
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    body = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    rate = lambda k, of: math.log1p(20 * k / of)  # noqa: E731  small shares count, large ones level off
    return [
        math.log1p(n),
        rate(_count(text, _UPPER), body),
        rate(_count(text, b"#*$%&<>@^~"), n),
        rate(text.count(b"|"), n),
        rate(text.count(b"!"), n),
        rate(_count(text, _DIGITS), body),
        rate(text.count(b"."), n),
        rate(text.count(b","), n),
        len(set(words)) / n,
        rate(sum(map(eq, words, words[1:])), n),
        math.log1p(body / n),
        rate(sum(len(w) > 24 for w in words), n),
        rate(len(lines), n),
        1 - len(set(lines)) / len(lines),
        rate(_count(text, bytes(range(128, 192))), body),
    ]


@dataclass
class Model:
    """Weights on standardised features, and the threshold; plain numbers."""

    mean: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the threshold falls on ``CUT``."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + math.log(CUT / (1 - CUT)), -40, 40)))


def paired(rows: DataFrame) -> DataFrame:
    """``(good, bad)`` features of pairs: every row of the larger class meets ``TURNS`` of the
    other, dealt round by the places of both in the order of their id hashes."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]
    placed = cut(ordered(rows, ["label"], order, {"place": position()}).select("label", "x", F.col("place") - 1).toDF("label", "x", "place"))
    counts = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = 1 if counts[1] >= counts[0] else 0
    few = counts[1 - many]
    turn = F.explode(F.sequence(F.lit(0), F.lit(min(TURNS, few) - 1)))
    left = placed.where(F.col("label") == many).select("x", "place", turn.alias("turn"))
    left = left.select("x", ((F.col("place") + F.col("turn") * max(1, few // TURNS)) % few).alias("place"))
    met = left.join(placed.where(F.col("label") == 1 - many).select(F.col("x").alias("y"), "place"), "place")
    good, bad = ("x", "y") if many else ("y", "x")
    return met.select(F.col(good).alias("good"), F.col(bad).alias("bad"))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(-1, len(FEATURES))


def bradley_terry(pairs: DataFrame, mean: np.ndarray, scale: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights that minimise the mean logistic loss of feature differences: Newton steps, halved
    where the loss would rise."""
    size = len(FEATURES)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros(2 + size + size * size)
            for b in batches:
                x, y = (((_matrix(b.column(c)) - mean) / scale).clip(-8, 8) for c in ("good", "bad"))
                d = x - y
                miss = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # the chance given to the wrong order
                total[0] += len(d)
                total[1] += np.logaddexp(0, -(d @ w)).sum()
                total[2 : 2 + size] += d.T @ miss
                total[2 + size :] += (d.T @ (d * (miss * (1 - miss))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        rows = pairs.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
        n = v[0]
        hessian = v[2 + size :].reshape(size, size) / n + ridge * np.eye(size)
        return v[1] / n + ridge / 2 * float(w @ w), v[2 : 2 + size] / n - ridge * w, hessian

    w = np.zeros(size)
    loss, down, hessian = sums(w)
    step = np.linalg.solve(hessian, down)
    for _ in range(STEPS):
        tried = sums(w + step)
        if tried[0] <= loss:
            w, (loss, down, hessian) = w + step, tried
            step = np.linalg.solve(hessian, down)
        else:
            step = step / 2
        if np.abs(step).max() < 1e-7:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled training rows (``labels.quality``).

    With labels of one kind only all scores are equal: ``CUT``.
    """

    def run(batches):
        for b in batches:
            read = b.column("text").cast(pa.binary()).to_pylist()
            x = pa.array([features(t) for t in read], pa.list_(pa.float64()))
            same = pa.array([hashlib.sha256(t).digest() for t in read], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), same, x], ["doc_id", "text_hash", "same", "x"])

    # Texts are read where they lie; ids, digests and features are what is joined and grouped.
    rows = texts(docs).where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("text_hash", F.xxhash64("text"))
    of_id = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(run, f"doc_id {of_id}, text_hash bigint, same binary, x array<double>")
    known = read.join(training_labels(labels, "quality").hint("merge"), "doc_id").groupBy("same").agg(
        F.when(F.max("label") == 1, 1).otherwise(0).alias("label"), F.min("doc_id").cast("string").alias("doc_id"),
        F.first("text_hash").alias("text_hash"), F.first("x").alias("x"),
    )
    seen = cut(known.drop("same"))
    columns = [F.col("x")[i] for i in range(len(FEATURES))]
    made = seen.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.stddev_pop(c) for c in columns]).alias("scale"),
    ).first()
    if not 0 < made["good"] < made["n"]:
        return Model()
    # Rounded, so that the model doesn't hang on the order in which sums are made.
    mean, scale = np.round(made["mean"], 9), np.round(np.array(made["scale"]) + 1e-6, 9)
    model = Model(mean.tolist(), scale.tolist(), np.round(bradley_terry(cut(paired(seen)), mean, scale), 9).tolist())

    def raw(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column("x"))), pa.float64())], ["raw"])

    at = (made["n"] - 1) * (1 - made["good"] / made["n"])
    scores = cut(seen.select("x").mapInArrow(raw, "raw double"))
    placed = ordered(scores, [], [F.col("raw")], {"place": position()})
    near = placed.where(F.col("place").isin(math.floor(at) + 1, math.ceil(at) + 1)).agg(F.avg("raw").alias("raw")).first()
    model.threshold = float(near["raw"])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row; other columns are ignored.

    Null and empty texts have the score of all features at zero; repeated rows have equal
    ones.
    """

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")

"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document of label 1 is preferred to one of label 0. With utility u = w.x,
P(i preferred to j) = sigmoid(u_i - u_j); w minimises the logistic loss on
feature differences x_i - x_j over seeded pairs. The utility's cut is a
quantile of the training utilities: the level with the best balanced accuracy.
The score is sigmoid(u - cut + logit(0.3)), so that 0.3 is that quantile.

Labels are learned from at most MAX_LABELLED ids per class, those of the
smallest hash, and of the documents of one id from that whose text has the
smallest hash; only their features (a few doubles each) reach the driver.
Scoring is one pass over the whole texts, without any shuffle.

Defined results: null and empty texts have all counts 0 and get a score like
any other; without labels of both classes every score is 0.5; repeated rows
are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lodestar.llm.common import fold, ship

MAX_LABELLED = 4000
PAIRS = 40_000
THRESHOLD = 0.3
SEED = 7

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "bar": b"|", "sign": b"*#$%&^~", "mark": b"@=<>{}[]\\_+/", "line": b"\n"}
FEATURES = ("log_words", "word_length", *(f"{name}_rate" for name in _CLASSES), "other_rate", "high_rate", "repeat_rate", "distinct_rate", "line_repeat_rate", "caps_rate")


def features(text: str | None) -> list[float]:
    """Rates of kinds of bytes, repeated words and repeated lines of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    kinds = {name: float(counts[list(chars)].sum()) for name, chars in _CLASSES.items()}
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    repeats = sum(map(str.__eq__, words[1:], words)) if len(words) > 1 else 0
    high = float(counts[128:].sum())
    other = max(0.0, len(raw) - sum(kinds.values()) - high - counts[32])
    rate = lambda x, of: float(np.log((x + 0.002 * of) / (0.002 * of)))  # noqa: E731  from 0 on, steep near 0
    return [
        float(np.log1p(len(words))), float(np.log1p(len(raw) / max(1, len(words)))),
        *(rate(x, n) for x in kinds.values()), rate(other, n), rate(high, n),
        rate(repeats, max(1, len(words))), len(set(words)) / max(1, len(words)) ** 0.9,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        rate(kinds["upper"], max(1.0, kinds["upper"] + kinds["lower"])),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def features_udf(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3) -> dict:
    """Weights, scaling and cut from features and labels 0/1."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "w": np.zeros(len(FEATURES)), "cut": float(np.log(THRESHOLD / (1 - THRESHOLD)))}
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton steps on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = ridge * w - d.T @ p / pairs
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    order = np.sort(u)
    levels = np.unique(np.searchsorted(order, order))[1:]  # each cut lies between two utilities
    hit = np.cumsum(label[np.argsort(u, kind="stable")] == 0)[levels - 1] / len(bad)
    lost = np.cumsum(label[np.argsort(u, kind="stable")] == 1)[levels - 1] / len(good)
    level = levels[int(np.argmax(hit - lost))] if len(levels) else 0
    cut = float((order[level - 1] + order[level]) / 2) if level else float(order[0] - 1)
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "level": level / len(order)}


def utility_to_score(x: np.ndarray, model: dict) -> np.ndarray:
    u = ((x - model["mean"]) / model["scale"]) @ model["w"] - model["cut"] + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(u, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model from labelled rows out of the held-out fold, at most max_labelled per class."""
    ship(docs.sparkSession)
    rows = labels.where((fold() != 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("of_doc"), F.col("quality").alias("of_label")).distinct()
    some = [rows.where(F.col("of_label") == q).orderBy(F.xxhash64("of_doc"), "of_doc").limit(max_labelled) for q in (0, 1)]
    chosen = F.broadcast(some[0].unionAll(some[1]))  # at most 2 * max_labelled ids
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of_doc")).select("of_doc", "of_label", F.xxhash64("text").alias("hash"), features_udf("text").alias("x"))
    found = found.groupBy("of_doc", "of_label").agg(F.min(F.struct("hash", "x"))["x"].alias("x"))  # one row an id and label, however often the id occurs
    got = found.toPandas().sort_values(["of_doc", "of_label"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["of_label"].to_numpy())


def score_of(text: Column, model: dict) -> Column:
    """The score of each whole text."""

    @F.pandas_udf(DoubleType())
    def score_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            yield pd.Series(utility_to_score(x, model))

    return score_udf(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = docs.select("doc_id", score_of(F.col("text"), train(docs, labels)).alias("score"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

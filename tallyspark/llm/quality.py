"""Quality classifier: hashed word n-grams, logistic regression by FTRL updates.

A document's words are its runs without white space. Every word gives two tokens: its
lower-case letters with punctuation kept, and its shape (runs of upper-case letters,
lower-case letters and digits become one sign each; a word equal to the one before becomes
``=``). Hashes of single tokens and of two and three neighbours are the features; a feature
weighs as many parts of the document as it has n-grams there. Scoring is a sparse dot
product of these parts and the weights.

Defined results: a null or empty text has no features and scores by the intercept; null
labels and ids are not learned from; without any labelled row every score is 0.5. Columns
other than the named ones are ignored, or passed through by ``keep_good``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Remembered, labelled_sample, per_value, remainder, ship, word_hash

#: Bound on the labelled rows that the classifier is fitted on.
TRAINING_ROWS = 20_000
#: Dimensions of the hashed feature space, a power of two.
DIMENSIONS = 1 << 18
#: Shards that are fitted side by side and averaged.
SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Features are parts of one; this brings them near one.
SCALE = 8.0
KEEP_FROM = 0.5

_RUNS = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|([^\W\d_]+)")
_FOLLOWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def shape(word: str) -> str:
    """``Hello,`` gives ``Aa,``; letters beyond ASCII count by their case."""

    def sign(run: re.Match) -> str:
        if run[1]:
            return "A"
        if run[2]:
            return "a"
        if run[3]:
            return "9"
        return "A" if run[4].isupper() else "a"

    return re.sub(r"a+", "a", re.sub(r"A+", "A", _RUNS.sub(sign, word)))


def _both(word: str) -> bytes:
    """Hashes of the word's two tokens, 16 bytes."""
    return struct.pack("<QQ", word_hash(word.lower()), word_hash("\0" + shape(word)))


_HASHES = Remembered(_both)
_SAME = np.uint64(word_hash("\0="))


def features(text: str | None) -> np.ndarray:
    """The hashed dimension of every n-gram of the text, repeats included."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    pairs = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 2)
    plain, shapes = pairs[:, 0], pairs[:, 1].copy()
    shapes[1:][plain[1:] == plain[:-1]] = _SAME
    grams = [plain, shapes]
    for tokens in (plain, shapes):
        two = tokens[:-1] * _FOLLOWS[0] + tokens[1:]
        grams.append(two)
    grams.append((shapes[:-2] * _FOLLOWS[1] + shapes[1:-1]) * _FOLLOWS[0] + shapes[2:])
    hashes = np.concatenate(grams)
    hashes ^= hashes >> np.uint64(29)
    hashes *= _FOLLOWS[1]
    return (hashes >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weights by dimension, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = features(text)
        dot = SCALE * float(self.weights[found].mean()) if len(found) else 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(dot + self.intercept, -30, 30))))


def follow_the_leader(rows: Iterable[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows in order; the last weight is the intercept's."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1 * (at != DIMENSIONS), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * (at != DIMENSIONS))

    sparse = []
    for found, label in rows:
        at, counts = np.unique(found, return_counts=True)
        values = np.append(SCALE * counts / max(1, len(found)), 1.0)
        sparse.append((np.append(at, DIMENSIONS).astype(np.int32), values.astype(np.float32), label))
    for _ in range(epochs):
        for at, values, label in sparse:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30)))
            gradient = (p - label) * values
            grown = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(DIMENSIONS + 1))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    in_training: Column | None = None,
    rows: int = TRAINING_ROWS,
) -> Model:
    """Fits on at most ``rows`` labelled rows; shards are fitted apart and averaged."""
    training = F.lit(True) if in_training is None else in_training
    sample = labelled_sample(labels, label, training, rows)
    ship(docs.sparkSession)
    # rows that repeat a labelled id are one training row, the one of the smallest text
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def fit_shards(shards):
        for number, shard in _gathered(shards):
            shard = shard.sort_values(["order", "doc_id", "text"], kind="stable")
            rows = zip(map(features, shard["text"]), shard["label"], strict=True)
            w = follow_the_leader(rows)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"shard": number, "at": at, "weight": w[at]})

    placed = known.select(
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).cast("int").alias("shard"),
        F.xxhash64(F.lit("order"), "doc_id").alias("order"),
        "doc_id",
        "text",
        "label",
    )
    fitted = placed.repartition(SHARDS, "shard").mapInPandas(
        fit_shards, "shard int, at long, weight double"
    )
    total = fitted.groupBy("at").agg(
        F.sum("weight").alias("weight"), F.collect_set("shard").alias("shards")
    )
    averaged = total.toPandas()
    w = np.zeros(DIMENSIONS + 1)
    shards = len(set().union(*averaged["shards"])) if len(averaged) else 1
    w[averaged["at"].to_numpy(np.int64)] = averaged["weight"].to_numpy(float) / shards
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _gathered(batches):
    """(shard, its rows): the batches of one partition, bounded by the training sample."""
    rows = [batch for batch in batches if len(batch)]
    if rows:
        yield from pd.concat(rows).groupby("shard")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fold 1 of 3 is held out."""
    model = fit(docs, labels, in_training=remainder(F.col("doc_id"), 3) != 1)
    return docs.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        per_value(model.score, "double")("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    model = fit(docs, labels, in_training=remainder(F.col("doc_id"), 3) != 1)
    return docs.filter(per_value(model.score, "double")("text") >= KEEP_FROM)

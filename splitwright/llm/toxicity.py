"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Learning is sequential, so a sample of bounded size is learned in one task. The L1 term leaves few weights,
at most ``2 ** BITS`` by construction, so they may be broadcast, and scoring is one pass over the documents
without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.llm.text import WordHashes, alnum_words, arrow_map, documents, mixed, remainder, texts_of, with_column
from splitwright.operators.checks import require_columns

BITS = 20
#: The sample: at most so many labelled rows, those with the smallest hash of the id.
TRAIN_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 1.0
THRESHOLD = 0.3
HELD_OUT = (4, 2)

_FIRST = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0x165667B19E3779F9)]
_SECOND = [np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5)]


def features(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Distinct coordinates of the words, the word pairs and the pairs with one word skipped."""
    words = hashes.of(alnum_words(text))
    parts = [words]
    with np.errstate(over="ignore"):
        for gap, (a, b) in enumerate(zip(_FIRST, _SECOND), 1):
            if len(words) > gap:
                parts.append(mixed(words[:-gap] * a + words[gap:] * b))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in rows:
            own_n = n[at]
            w = weight(z[at], own_n)
            bias = -bias_z * ALPHA / (BETA + math.sqrt(bias_n))
            g = sigmoid(float(w.sum()) + bias) - label
            z[at] += g - (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA * w
            n[at] = own_n + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weight(z, n), -bias_z * ALPHA / (BETA + math.sqrt(bias_n))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def _views(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as slices of their values."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``_order, toxic, at`` of the sample: tasks turn texts into coordinates, so the one task that learns gets no text."""
    require_columns(labels, ["doc_id", "toxic"], "labels")
    modulus, out = HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != out))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS)
    # the limit bounds what is broadcast, so the texts of all other rows stay where they are
    rows = documents(docs).join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id", "text").alias("_order"), "toxic", "text")

    def work():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch):
            at = pa.array([features(t, hashes) for t in texts_of(batch["text"])], pa.list_(pa.int32()))
            yield pa.record_batch([batch["_order"], batch["toxic"], at], ["_order", "toxic", "at"])

        return step

    return arrow_map(rows, work, "_order long, toxic int, at array<int>")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights; coordinate ``-1`` is the intercept. No labelled row gives none."""

    def fit(group: pa.Table) -> pa.Table:
        keys = group.select(["_order", "toxic"]).append_column("row", pa.array(np.arange(group.num_rows)))
        keys = keys.sort_by([("_order", "ascending"), ("toxic", "ascending")])
        # views of the received arrays, in the order of the batches: no text and no copy of all features is held
        lists = [x for c in group["at"].chunks for x in _views(c)]
        w, bias = ftrl([(lists[i], y) for i, y in zip(keys["row"].to_pylist(), keys["toxic"].to_pylist())])
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "weight": pa.array(np.append(w[at], bias), pa.float64())})

    found = training_rows(docs, labels).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "at long, weight double").toArrow()
    return found["at"].to_numpy(), found["weight"].to_numpy()


def score_name(df: DataFrame) -> str:
    """A column name that the table does not have."""
    name = "_score"
    while name in df.columns:
        name += "_"
    return name


def scored(df: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``df`` with the score of its string column ``text`` in ``score_name(df)``."""
    name = score_name(df)
    held = df.sparkSession.sparkContext.broadcast(model)

    def work():
        at, weights = held.value
        dense = np.zeros(1 << BITS)
        dense[at[at >= 0]] = weights[at >= 0]
        bias = weights[at == -1].sum()
        hashes = WordHashes()

        def step(batch: pa.RecordBatch):
            # without a model nothing is known to be toxic
            scores = [sigmoid(dense[features(t, hashes)].sum() + bias) if len(at) else 0.0 for t in texts_of(batch["text"])]
            yield with_column(batch, **{name: pa.array(scores, pa.float64())})

        return step

    return arrow_map(df, work, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels that are null or not 0 or 1, and labels of unknown documents, are passed over; a label given
    twice counts twice. Null and empty texts score the intercept alone, every row of a null id is not held
    out. Without any label all scores are 0. Other columns are not read.
    """
    modulus, out = HELD_OUT
    found = scored(documents(docs), train(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), modulus) == out, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    name = score_name(docs)
    return scored(docs.withColumn("text", F.col("text").cast("string")), train(docs, labels)).where(F.col(name) < threshold).drop(name)

"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Words are runs of letters and digits and runs of symbols, so that decoration is a
word as well; a mark is put before a word in capitals and before a repeated word.
Unigrams and bigrams are hashed into 2**18 features with values
log(1 + count) / norm.

Training reads a bounded sample of labelled rows, ``TRAIN_ROWS`` by the smallest
hash of the id.  The sample is dealt to ``SHARDS`` tasks; each makes ``EPOCHS``
passes of follow-the-regularised-leader updates (per-coordinate rates, L1 and
L2), and their weights are averaged.  Scoring is one scan: a sparse dot product
per document against a weight vector of fixed size.

Defined cases: null text is empty and scores by the bias alone; null labels and
labels without a document are ignored; several labels of one id count as 1 if
any is; without labelled rows, or with one class only, the weights are zero plus a
bias, and without any the score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 4
EPOCHS = 5
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.0, 0.0
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_CAPS, _SAME, _EMPTY = (np.uint64(x) for x in (11, 13, 17))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values; feature 0 is the bias."""
    words = _WORD.findall(text or "")
    lower = [w.lower() for w in words]
    h = np.fromiter((crc32(w.encode()) for w in lower), np.uint64, len(words)) + np.uint64(1 << 33)
    caps = np.fromiter((len(w) > 1 and w.isupper() for w in words), bool, len(words))
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.empty(0, bool)
    marks = np.r_[np.full(caps.sum(), _CAPS), np.full(same.sum(), _SAME), np.full(int(not len(h)), _EMPTY)].astype(np.uint64)
    pairs = h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 40)
    hashed = (np.r_[h, marks, pairs] * _STEP) >> np.uint64(64 - bits)
    found, counts = np.unique(hashed.astype(np.int64) % ((1 << bits) - 1) + 1, return_counts=True)
    values = np.log1p(counts)
    return np.r_[0, found].astype(np.int32), np.r_[1.0, values / (np.linalg.norm(values) or 1.0)]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates over (label, features, values)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at) -> np.ndarray:
        lazy = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, lazy, 0.0)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            label, at, x = rows[i]
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, rows: int = TRAIN_ROWS,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(label, text) of a bounded sample of labelled rows outside the held-out fold 0."""
    sample = (labels.filter((fold("doc_id") != 0) & F.col(column).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").alias("__id")).agg(F.max(column).cast("int").alias("label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(rows))
    # At most ``rows`` pairs of numbers: a broadcast of bounded size.
    return docs.select(F.col(id_column).alias("__own"), F.col(text_column).alias("text")).join(
        F.broadcast(sample), F.col("__own") == F.col("__id")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, shards: int = SHARDS, bits: int = BITS,
          id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """The weight vector, 2**bits numbers."""
    sample = training_rows(docs, labels, "quality", rows, id_column, text_column)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):  # features are larger than their text
                batch = whole.slice(begin, 500)
                made = [features(t, bits) for t in batch.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(m[0]) for m in made)]), pa.int32())
                at, x = (pa.ListArray.from_arrays(offsets, np.concatenate([m[i] for m in made])) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), at, x], ["label", "at", "x"])

    def learn(table: pa.Table) -> pa.Table:
        data = []
        for batch in table.to_batches():
            at, x = batch.column("at"), batch.column("x")
            ends = at.offsets.to_numpy()[1:-1]
            data += zip(batch.column("label").to_pylist(), np.split(at.values.to_numpy(), ends),
                        np.split(x.values.to_numpy(), ends), strict=True)
        w = ftrl(data, bits=bits)
        used = np.flatnonzero(w)
        return pa.table({"feature": pa.array(used, pa.int32()), "weight": pa.array(w[used], pa.float64())})

    made = staged(sample.mapInArrow(featured, "label int, at array<int>, x array<double>"), "features")
    dealt = made.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    weights = np.zeros(1 << bits)
    for row in (dealt.groupBy("shard").applyInArrow(learn, "feature int, weight double")
                .groupBy("feature").agg(F.sum("weight").alias("weight")).collect()):  # 2**bits rows at most
        weights[row["feature"]] = row["weight"] / shards
    return weights


def _score(weights: np.ndarray, text: str | None, bits: int) -> float:
    at, x = features(text, bits)
    return float(1.0 / (1.0 + np.exp(-np.clip(weights[at] @ x, -35, 35))))


def score(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score): the probability of label 1."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    bits, kind = len(weights).bit_length() - 1, rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_score(shared.value, t, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return rows.mapInArrow(scored, f"id {kind}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with their own columns."""
    bits, at = len(weights).bit_length() - 1, docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([_score(shared.value, t, bits) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(good, docs.schema)

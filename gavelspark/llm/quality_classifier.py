"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are lower-cased (A-Z) runs of letters, of digits, or of marks, so marks glued to a word are words of their own. Single words and
pairs are hashed to a fixed number of weights; a text is the vector of the logarithms of their counts, of length one.
FTRL-proximal sees a bounded sample of labelled rows in a fixed order, some times over, in one task. Scores are sparse dot
products over every whole text, each by itself, so no document is shuffled.

Defined results: null and empty texts have no features and score the bias; rows with equal ids are scored each by itself; a label
that is null or not 0 or 1 is ignored, of several the smallest counts; without usable labels of both kinds every score is the share
of good labels, or one half. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.shared import by_batches, crc_bucket, sampled
from gavelspark.llm.words import find_words, sequence_hashes

FOLDS = 5
THRESHOLD = 0.3
SAMPLE_ROWS = 10_000  # labelled rows used for fitting, at most
BITS = 18
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.0

_LETTERS = [b for b in range(256) if b >= 0x80 or chr(b).isalpha()]
KINDS = np.full(256, 3, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[_LETTERS] = 1
KINDS[ord("0"):ord("9") + 1] = 2


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weight numbers, values) of a column of texts, by row."""
    words = find_words(column, lower=True, kinds=KINDS)
    first, pairs = words.shingles(2)
    single = sequence_hashes(words.hashes, np.arange(len(words.hashes)), 1)
    rows = np.concatenate([words.rows, words.rows[first]])
    slots = (np.concatenate([single, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique((rows << BITS) | slots, return_counts=True)
    rows, slots, values = keys >> BITS, keys & ((1 << BITS) - 1), np.log1p(counts)
    length = np.sqrt(np.bincount(rows, values * values, words.n_rows))
    return rows, slots, values / length[rows]


class Leader:
    """FTRL-proximal: weights follow from the sums of adjusted gradients (z) and of their squares (n). The last one is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights, the bias last, from at most `rows` of the labelled documents outside the held-out fold."""
    mark = F.col("quality").try_cast("double")  # labels may be stored as any number or as text
    usable = labels.where(mark.isin(0.0, 1.0) & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != 0))
    marks = usable.groupBy("doc_id").agg(F.min(mark).cast("int").alias("quality"))
    picked = docs.select("doc_id", "text").join(F.broadcast(sampled(marks, "doc_id", rows)), "doc_id")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, slots, values = features(batch.column("text"))
        cuts = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (slots.astype(np.int32), values.astype(np.float32))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *lists], ["doc_id", "quality", "slots", "values"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            slots, values = batch.column("slots"), batch.column("values")
            seen += [(slots[k].values.to_numpy(), values[k].values.to_numpy(), y) for k, y in enumerate(batch.column("quality").to_pylist())]
        leader = Leader(1 << BITS)
        good = sum(y for *_, y in seen)
        if 0 < good < len(seen):
            for _ in range(EPOCHS):
                for slots, values, y in seen:
                    leader.update(slots, values, y)
            weights = leader.weights()
        else:
            weights = np.zeros((1 << BITS) + 1)
            weights[-1] = 0.0 if not seen else 30.0 if good else -30.0
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32)], pa.list_(pa.float32()))], ["weights"])

    found = by_batches(picked, extract, "doc_id long, quality int, slots array<int>, values array<float>")
    ordered = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "slots", "values")
    made = ordered.mapInArrow(train, "weights array<float>").toArrow()
    return made.column("weights")[0].values.to_numpy() if made.num_rows else np.zeros((1 << BITS) + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        rows, slots, values = features(batch.column("text"))
        score = sigmoid(np.bincount(rows, w[slots] * values, len(batch)) + w[-1])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return by_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")

"""Language by interpolated Kneser-Ney models of characters, one for each language, in sorted hash arrays.

A text is its letters, lower-cased, with one space for whatever stands between them. For each language every order up to four interpolates
discounted counts with the order below; lower orders count in how many contexts a character was seen. All n-grams that any language knows are
sorted by hash, next to their probabilities in each. A text gets the language of least cross-entropy per character; where even that is above
what all but a few of the language's own labelled texts have, the result is marked as rejected and its score lowered.

N-grams are counted in Spark over a sample of about so many labelled documents of each language; a further sample calibrates
rejection. Each distinct n-gram of a piece of text is looked up once; every document is judged by itself, whole, without a shuffle.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing is labelled; rows with equal ids
are judged each by itself; of languages with equal entropy the first by code point is taken; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.shared import by_batches, crc_bucket
from gavelspark.llm.words import mix

FOLDS = 3
UNKNOWN = "und"
ORDER = 4
SAMPLE_DOCS = 1500  # of each language for counting, about
CALIBRATION_DOCS = 400  # of each language for rejection, about
ACCEPTED = 0.995  # share of the calibration documents of a language that are not rejected
SHARPNESS = 10.0  # of scores: by how much a lead of one nat per character multiplies the odds, as a logarithm
_BITS = 21
_MASK = (1 << _BITS) - 1
_ALPHA = np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, rows, letters by row): 0 for a gap; each text that has a letter begins with ORDER - 1 gaps and ends with one."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _ALPHA[np.minimum(codes, (1 << 16) - 1)]
    high = codes >= 1 << 16
    if high.any():
        values, at = np.unique(codes[high], return_inverse=True)
        known[high] = np.array([chr(c).isalpha() for c in values])[at]
    rows = np.repeat(np.arange(len(texts)), lengths)
    counts = np.bincount(rows[known], minlength=len(texts))
    codes = np.where(known, codes, 0)
    keep = known.copy()
    keep[1:] |= known[:-1] & (rows[1:] == rows[:-1])  # the first of each run of others
    codes, rows = codes[keep], rows[keep]
    some = np.flatnonzero(counts)
    first, last = np.searchsorted(rows, some), np.searchsorted(rows, some, side="right")
    open_end = some[codes[last - 1] != 0] if len(some) else some
    # gaps that end a text come before those that begin the next one
    at = np.concatenate([np.searchsorted(rows, open_end, side="right"), np.repeat(first, ORDER - 1)])
    return np.insert(codes, at, 0), np.insert(rows, at, np.concatenate([open_end, np.repeat(some, ORDER - 1)])), counts


def grams(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half, row) of every run of ORDER characters; two characters in each half."""
    n = max(len(codes) - ORDER + 1, 0)
    at = np.flatnonzero(rows[:n] == rows[ORDER - 1:][:n]) if n else np.zeros(0, np.int64)
    c = codes.astype(np.int64)
    return (c[at] << _BITS) | c[at + 1], (c[at + 2] << _BITS) | c[at + 3], rows[at]


def keys(first: np.ndarray, second: np.ndarray, order: int, context: bool = False) -> np.ndarray:
    """Hashes of the last `order` characters, or of those before the last one of them."""
    chars = [first >> _BITS, first & _MASK, second >> _BITS, second & _MASK][ORDER - order:]
    total = np.full(len(first), order - context, np.uint64)
    for c in chars[:-1] if context else chars:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return total


@dataclass
class Sorted:
    """Rows of values by sorted hash."""

    hashes: np.ndarray
    values: np.ndarray

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of each wanted hash."""
        if not len(self.hashes):
            return np.zeros((len(wanted), self.values.shape[1])), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return self.values[at], self.hashes[at] == wanted


@dataclass
class Models:
    """For each order the probabilities of known n-grams and the weights that contexts leave to the order below; by language."""

    languages: list[str]
    known: list[Sorted] = field(default_factory=list)
    left: list[Sorted] = field(default_factory=list)
    floor: np.ndarray | None = None
    limits: np.ndarray | None = None

    def probabilities(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of the last character of each run after the others, in each language."""
        out = np.broadcast_to(self.floor, (len(first), len(self.languages)))
        for order in range(1, ORDER + 1):
            weight, seen = self.left[order - 1](keys(first, second, order, context=True))
            out = np.where(seen[:, None], weight, 1.0) * out
            value, found = self.known[order - 1](keys(first, second, order))
            out = out + np.where(found[:, None], value, 0.0)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character in each language, letters) of each text."""
        codes, rows, counts = letters(column)
        first, second, row = grams(codes, rows)
        whole = keys(first, second, ORDER)
        _, one, at = np.unique(whole, return_index=True, return_inverse=True)
        cost = -np.log(self.probabilities(first[one], second[one]))
        n = np.maximum(np.bincount(row, minlength=len(counts)), 1)
        return np.stack([np.bincount(row, c[at], len(counts)) / n for c in cost.T], 1), counts

    def judged(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        entropy, counts = self.entropies(column)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        lead = 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(1)
        rejected = (counts == 0) | (least > self.limits[best])
        score = np.where(counts > 0, lead * np.minimum(1.0, self.limits[best] / np.maximum(least, 1e-9)), 0.0)
        return [self.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), counts.tolist(), strict=True)], score, rejected


def _sums(labels: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, n_languages: int) -> Models:
    """Kneser-Ney models from the counts of whole n-grams; `labels` has the number of each one's language."""
    models = Models([])
    alphabet = len(np.unique(keys(first, second, 1)))
    models.floor = np.full(n_languages, 1.0 / (alphabet + 1))
    layers = []
    for order in range(ORDER, 0, -1):
        layers.append((labels, first, second, counts))
        # the order below counts the different characters before it
        shorter = keys(first, second, order - 1) if order > 1 else np.zeros(len(first), np.uint64)
        _, one, at = np.unique(mix(shorter) + labels.astype(np.uint64), return_index=True, return_inverse=True)
        labels, first, second, counts = labels[one], first[one], second[one], np.bincount(at)
    for order, (labels, first, second, counts) in zip(range(1, ORDER + 1), layers[::-1], strict=True):
        once, twice = (np.bincount(labels[counts == k], minlength=n_languages) for k in (1, 2))
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.9)
        context, at = np.unique(keys(first, second, order, context=True), return_inverse=True)
        slot = at * n_languages + labels
        total = np.bincount(slot, counts, len(context) * n_languages)
        kinds = np.bincount(slot, minlength=len(context) * n_languages)
        d = np.broadcast_to(discount, (len(context), n_languages))
        weight = np.where(total > 0, d.ravel() * kinds / np.maximum(total, 1), 1.0)
        gram, row = np.unique(keys(first, second, order), return_inverse=True)
        value = np.zeros((len(gram), n_languages))
        value[row, labels] = (counts - discount[labels]) / total[slot]
        models.left.append(Sorted(context, weight.reshape(-1, n_languages)))
        models.known.append(Sorted(gram, value))
    return models


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, calibration: int = CALIBRATION_DOCS) -> Models:
    """Models of all languages that label documents outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != 1))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda s: s.encode())
    if not languages:
        return Models([])
    spark = docs.sparkSession
    numbers = spark.createDataFrame(
        [(lang, k, sample / sizes[lang], (sample + calibration) / sizes[lang]) for k, lang in enumerate(languages)], "lang string, number int, upto double, upto2 double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.withColumn("drawn", drawn).join(F.broadcast(numbers), "lang").where("drawn < upto2")
    picked = picked.select("text", "number", (F.col("drawn") < F.col("upto")).alias("counts"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, at, _ = letters(batch.column("text"))
        first, second, row = grams(codes, at)
        number = batch.column("number").to_numpy()[row]
        _, one, n = np.unique(mix(keys(first, second, ORDER)) + number.astype(np.uint64), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (number[one], first[one], second[one], n)], ["number", "first", "second", "n"])

    counted = by_batches(picked.where("counts"), count, "number int, first long, second long, n long")
    found = counted.groupBy("number", "first", "second").agg(F.sum("n").alias("n")).toArrow()
    columns = [found.column(c).to_numpy() for c in ("number", "first", "second", "n")]
    order = np.lexsort(columns[:3])
    models = _sums(*(c[order] for c in columns), len(languages))
    models.languages = languages
    models.limits = np.full(len(languages), np.inf)
    shared = spark.sparkContext.broadcast(models)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        entropy, counts = shared.value.entropies(batch.column("text"))
        number = batch.column("number").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(entropy[np.arange(len(number)), number])], ["number", "entropy"]).filter(pa.array(counts > 0))

    # Where all of a language is in the first sample, that has to do for its limit too.
    whole = {k for k, lang in enumerate(languages) if sizes[lang] <= sample}
    further = picked.where(~F.col("counts") | F.col("number").isin(*whole)) if whole else picked.where("not counts")
    measured = by_batches(further, measure, "number int, entropy double").groupBy("number").agg(F.percentile("entropy", ACCEPTED).alias("limit")).collect()
    for r in measured:
        models.limits[r.number] = r["limit"]
    return models


def identified(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score, rejected = shared.value.judged(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket(F.col("doc_id"), FOLDS) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return by_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

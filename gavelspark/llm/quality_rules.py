"""Quality rules: fixed limits on counts, then an isolation forest on rule statistics.

The forest isolates points by random cuts; a document that few cuts separate from the good labelled ones is an anomaly. Cuts are
drawn over the range of all labelled rows, so values that no good document has are isolated too. The share of good rows that a
score rejects, weighed against the share of bad ones, sets the threshold. Every labelled row counts: the range and the threshold
are those of all, and each tree draws its rows from all good ones. Only ids and features are shuffled for that, never texts;
labelled rows of the same features are one point with its counts. Statistics and verdicts cover every document, each by itself.

Defined results: null and empty texts count 0 everywhere, fail the base rules and are not kept; rows with equal ids are judged
each by itself; other columns are left alone; without usable labels of both kinds only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.llm.shared import by_batches, written
from gavelspark.llm.words import SHINGLE, find_words, per_row

# Fixed values.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

TREES = 100
TREE_ROWS = 256
MAX_DEPTH = 12
FALSE_REJECT_COST = 10.0  # a good document rejected costs as much as so many bad ones kept
SEED = 7

POINT_GROUPS = 1 << 12  # groups of points by hash, in which good rows have their places
SCORE_GROUPS = 1 << 14  # ranges of scores, in which gains are summed up
SCORE_ROWS = 1 << 11  # points scored at once

N_FEATURES = 7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_IS_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_IS_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_IS_MARK = np.isin(np.arange(256), [x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in ",.'-"])


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of each text: the columns of COUNTS, and the shares that the forest looks at."""
    words = find_words(column)
    n = words.n_rows
    n_words = words.counts()
    code_points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    word_chars = np.bincount(words.rows, code_points[words.ends] - code_points[words.starts], n).astype(np.int64)
    symbols = per_row(_IS_SYMBOL[words.data], words.offsets)

    first, window = words.shingles()
    order = np.lexsort((window, words.rows[first]))
    same = (np.diff(window[order]) == 0) & (np.diff(words.rows[first][order]) == 0)
    again = np.zeros(len(first), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    repeated = np.zeros(len(words.hashes) + SHINGLE, bool)
    for k in range(SHINGLE):
        repeated[first[again] + k] = True
    repeat_words = np.bincount(words.rows[repeated[:len(words.hashes)]], minlength=n)

    breaks = np.flatnonzero(words.data == 10)
    starts = np.union1d(words.offsets[:-1], breaks + 1)
    starts = starts[starts < len(words.data)]
    ends = np.minimum(np.append(starts[1:], len(words.data)), len(words.data))
    ends = ends - np.isin(ends, breaks + 1)  # a line is without its break
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    rows = np.searchsorted(words.offsets, starts, side="right") - 1
    lines = words.span_hashes(starts, ends)
    n_lines = np.bincount(rows, minlength=n)
    order = np.lexsort((lines, rows))
    later = (np.diff(lines[order]) == 0) & (np.diff(rows[order]) == 0)
    dup_lines = np.bincount(rows[order[1:][later]], minlength=n)

    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeat_words], 1).astype(np.int64)
    some, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack([
        np.minimum(symbols / some, 4), np.minimum(per_row(_IS_MARK[words.data], words.offsets) / some, 4),
        per_row(_IS_UPPER[words.data], words.offsets) / chars, per_row(_IS_DIGIT[words.data], words.offsets) / chars,
        dup_lines / np.maximum(n_lines, 1), repeat_words / some, np.minimum(word_chars / some, 40) / 40,
    ], 1)
    return counts, np.sqrt(features)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


@dataclass
class Forest:
    """Complete binary trees: node i has children 2i+1 and 2i+2; a leaf has feature -1. Scores above the threshold are anomalies."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(MAX_DEPTH):
            feature = self.feature[tree, node]
            right = x[row, np.maximum(feature, 0)] >= self.cut[tree, node]
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        return 2.0 ** (-self.path[tree, node].mean(1) / _mean_path(TREE_ROWS))


def points(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features that labelled documents within the base rules have, with the numbers of good and bad ones."""
    mark = F.col("quality").try_cast("double")  # labels may be stored as any number or as text
    marks = labels.where(mark.isin(0.0, 1.0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(mark).cast("long").alias("quality"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = statistics(batch.column("text"))
        passed = ~base_failed(counts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").filter(pa.array(passed)), pa.array(list(features[passed]), pa.list_(pa.float64()))], ["doc_id", "features"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("features", T.ArrayType(T.DoubleType()))])
    measured = by_batches(docs.select("doc_id", "text").where("doc_id is not null"), measure, schema)
    quality = F.col("quality")
    return measured.join(marks, "doc_id").groupBy("features").agg(F.sum(quality).alias("good"), F.sum(1 - quality).alias("bad"))


def _features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def tree_rows(found: DataFrame, n_good: int) -> Callable[[int, np.random.Generator], np.ndarray]:
    """Gives the rows of tree t: TREE_ROWS drawn without replacement from all good rows, or all if there are fewer.

    Up to as many rows as the trees take together are brought here and drawn from in the order of their features. Of more rows,
    places are drawn first, and only the rows at these places come.
    """
    good = found.where("good > 0")
    if n_good <= TREES * TREE_ROWS:
        table = good.select("features", "good").toArrow()
        rows = np.repeat(_features(table.column("features")), table.column("good").to_numpy(), axis=0)
        rows = rows[np.lexsort(rows.T)]
        return lambda t, random: rows[random.choice(n_good, min(TREE_ROWS, n_good), replace=False)]

    good = good.withColumn("group", F.pmod(F.xxhash64("features"), F.lit(POINT_GROUPS)))
    sizes = np.zeros(POINT_GROUPS, np.int64)
    for group, size in good.groupBy("group").agg(F.sum("good")).collect():
        sizes[group] = size
    ends = np.cumsum(sizes)
    places = [np.random.default_rng([SEED, t]).choice(n_good, TREE_ROWS, replace=False) for t in range(TREES)]
    wanted = np.unique(np.concatenate(places))
    group = np.searchsorted(ends, wanted, side="right")
    asked = found.sparkSession.createDataFrame(pa.table({"place": wanted, "group": group, "at": wanted - (ends - sizes)[group]}))
    upto = F.sum("good").over(Window.partitionBy("group").orderBy("features").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    there = good.withColumn("upto", upto).join(F.broadcast(asked), "group").where("at < upto and at >= upto - good")
    table = there.select("place", "features").toArrow()
    rows = _features(table.column("features"))[np.argsort(table.column("place").to_numpy())]
    return lambda t, random: rows[np.searchsorted(wanted, places[t])]


def grow(rows_of: Callable[[int, np.random.Generator], np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = SEED) -> Forest:
    """Trees over the rows of each, with cuts drawn from the box of all labelled rows."""
    random, size = np.random.default_rng(seed), 2 ** (MAX_DEPTH + 1) - 1
    feature, cut, path = np.full((TREES, size), -1, np.int16), np.zeros((TREES, size)), np.zeros((TREES, size))
    usable = np.flatnonzero(high > low)
    for t in range(TREES):
        todo = [(0, 0, rows_of(t, random), low.copy(), high.copy())]
        while todo:
            node, depth, x, lo, hi = todo.pop()
            path[t, node] = depth + _mean_path(len(x))
            if len(x) <= 1 or depth == MAX_DEPTH or not len(usable):
                continue
            f = random.choice(usable)
            c = random.uniform(lo[f], hi[f])
            feature[t, node], cut[t, node] = f, c
            right = x[:, f] >= c
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = c
            todo += [(2 * node + 1, depth + 1, x[~right], lo, below), (2 * node + 2, depth + 1, x[right], above, hi)]
    return Forest(feature, cut, path)


def calibrated(forest: Forest, found: DataFrame) -> Forest:
    """Sets the threshold of least cost over all labelled rows; 1 (none is above) if rejecting never pays.

    Gains are summed up from the highest score down within ranges of scores; only a line for each range comes to the driver.
    """
    shared = found.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCORE_ROWS):
                piece = batch.slice(at, SCORE_ROWS)
                scores = shared.value.scores(_features(piece.column("features")))
                yield pa.RecordBatch.from_arrays([pa.array(scores), piece.column("good"), piece.column("bad")], ["score", "good", "bad"])

    step = F.sum("bad") - FALSE_REJECT_COST * F.sum("good")
    steps = found.mapInArrow(score, "score double, good long, bad long").groupBy("score").agg(step.alias("step"))
    down = Window.partitionBy("group").orderBy(F.desc("score"))
    gain = F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = steps.withColumn("group", F.floor(F.col("score") * SCORE_GROUPS)).withColumns({"gain": gain, "below": F.lead("score").over(down)})
    ranges = summed.groupBy("group").agg(
        F.max(F.struct("gain", "score", "below")).alias("best"), F.max("score").alias("top"), F.sum("step").alias("total")).collect()
    ranges.sort(key=lambda r: -r.group)
    forest.threshold, most, above = 1.0, 0.0, 0.0
    for r, lower in zip(ranges, [*(r.top for r in ranges[1:]), 0.0], strict=True):
        if above + r.best.gain > most:
            most = above + r.best.gain
            forest.threshold = (r.best.score + (lower if r.best.below is None else r.best.below)) / 2
        above += r.total
    return forest


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold from all labelled documents within the base rules; None if good or bad ones are missing."""
    found = written(points(docs, labels))
    box = [f(F.col("features")[k]) for f in (F.min, F.max) for k in range(N_FEATURES)]
    n_good, n_bad, *ends = found.agg(F.sum("good"), F.sum("bad"), *box).first()
    if not n_good or not n_bad:
        return None
    return calibrated(grow(tree_rows(found, n_good), np.array(ends[:N_FEATURES]), np.array(ends[N_FEATURES:])), found)


def _judged(column: pa.Array, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, features = statistics(column)
    failed = base_failed(counts)
    scores = forest.scores(features) if forest else np.zeros(len(failed))
    return counts, failed, scores, ~failed & (scores <= (forest.threshold if forest else 1.0))


def verdicts(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the anomaly score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, scores, kept = _judged(batch.column("text"), shared.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(scores)],
            ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double"
    return by_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), judge, schema)


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The documents that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_judged(batch.column("text"), shared.value)[3]))

    return by_batches(docs, judge, docs.schema)

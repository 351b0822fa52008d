"""Repeated passages: content-defined chunks of words, deduplicated by digest.

A gear hash rolls over the words of a text and shifts by a bit for each, so a few of its bits depend on the last three words only.
Where two bits are zero, about every fourth word, is a cut. From every cut a chunk reaches to the first cut at least MIN_WORDS
words on. Cuts move with the words around them: an insertion changes the chunks it touches, and a passage has the same chunks
wherever it stands, but for those over its edges. Of equal chunks the first by (doc_id, place) stays, the words of the others
go; words that a first chunk covers always stay, so each repeated chunk is still there once.

A repeated passage of L words holds a whole chunk unless the words before its first cut and after its last one leave fewer than
MIN_WORDS, which at 51 words happens to one in five hundred; a repeat of less than MIN_WORDS words is never touched.

Chunks are first counted by digest, combined before the shuffle; those of digests that occur once go no further. Digests have
64 bits. Defined results: null, empty and short texts stay as they are; documents without id stay whole; rows with equal id and
text are one document and neither loses to the other; other columns are left alone, n_chars follows the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.llm.shared import by_batches, written
from gavelspark.llm.words import Words, find_words, mix

MIN_WORDS = 20
CUT_MASK = 0b110  # two bits that depend on three words
_R, _R_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_SPANS = "__spans"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def chunks(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first words, words after the last, digests); words are counted over the whole column."""
    n = len(words.hashes)
    gear = words.hashes >> np.uint64(20)
    rolled = gear.copy()
    same = words.rows[1:] == words.rows[:-1]
    rolled[1:] += np.where(same, gear[:-1] << np.uint64(1), np.uint64(0))
    rolled[2:] += np.where(words.rows[2:] == words.rows[:-2], gear[:-2] << np.uint64(2), np.uint64(0))
    cut = np.zeros(n + 1, bool)
    cut[1:] = (rolled & np.uint64(CUT_MASK)) == 0
    begin = np.searchsorted(words.rows, np.arange(words.n_rows + 1))
    cut[begin] = True
    cuts = np.flatnonzero(cut)
    starts = cuts[cuts < n]
    ends = cuts[np.minimum(np.searchsorted(cuts, starts + min_words), len(cuts) - 1)]
    rows = words.rows[starts]
    whole = (ends - starts >= min_words) & (ends <= begin[rows + 1])
    starts, ends, rows = starts[whole], ends[whole], rows[whole]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * _powers(_R, n), out=sums[1:])
    digests = mix((sums[ends] - sums[starts]) * _powers(_R_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return rows, starts, ends, digests.view(np.int64)


def _all_chunks(docs: DataFrame, min_words: int) -> DataFrame:
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = find_words(piece.column("text"))
        rows, starts, _, digests = chunks(words, min_words)
        begin = np.searchsorted(words.rows, np.arange(words.n_rows + 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(digests), piece.column("doc_id").take(pa.array(rows)), pa.array((starts - begin[rows]).astype(np.int32))],
            ["digest", "doc_id", "start"])

    return by_batches(docs, run, "digest long, doc_id long, start int")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and its chunks that occur more than once in the corpus: where they start, their digest, the first document with it."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = _all_chunks(docs, min_words)
    often = every.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    found = written(every.join(often, "digest"))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "digest", "first")).alias(_SPANS))


def _without(piece: pa.RecordBatch, min_words: int) -> tuple[list[bytes | None], np.ndarray, list[list[int]]]:
    """Each row's text without its later repeats, the words it lost, and the documents that keep them."""
    words = find_words(piece.column("text"))
    rows, starts, ends, digests = chunks(words, min_words)
    begin = np.searchsorted(words.rows, np.arange(words.n_rows + 1))
    part = np.searchsorted(rows, np.arange(words.n_rows + 1))
    ids = piece.column("doc_id").to_pylist()
    texts, lost, keepers = [], np.zeros(len(piece), np.int64), []
    whole = words.data.tobytes()
    missing = piece.column("text").is_null().to_pylist()
    for k, spans in enumerate(piece.column(_SPANS)):
        own = None if missing[k] else whole[words.offsets[k]:words.offsets[k + 1]]
        keepers.append([])
        texts.append(own)
        if not spans.is_valid or own is None or part[k] == part[k + 1]:
            continue
        start, digest, first = (spans.values.field(c).to_numpy() for c in ("start", "digest", "first"))
        here = slice(part[k], part[k + 1])
        at = np.minimum(np.searchsorted(starts[here], start + begin[k]), part[k + 1] - part[k] - 1) + part[k]
        good = (starts[at] == start + begin[k]) & (digests[at] == digest)  # else it is of another row with this id
        at, one = np.unique(at[good], return_index=True)
        digest, first = digest[good][one], first[good][one]
        order = np.lexsort((at, digest))
        at, digest, first = at[order], digest[order], first[order]
        new = np.append(True, np.diff(digest) != 0)[:len(at)]
        stays = (first == ids[k]) & new
        change = np.zeros(begin[k + 1] - begin[k] + 1, np.int64)
        kept = change.copy()
        for mark, which in ((change, at[~stays]), (kept, at[stays])):
            np.add.at(mark, starts[which] - begin[k], 1)
            np.add.at(mark, ends[which] - begin[k], -1)
        gone = (np.cumsum(change)[:-1] > 0) & ~(np.cumsum(kept)[:-1] > 0)
        if not gone.any():
            continue
        lost[k] = gone.sum()
        keepers[-1] = np.unique(first[~stays]).tolist()
        edges = np.append(words.starts[begin[k]:begin[k + 1]], words.offsets[k + 1])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out, last = [], words.offsets[k]
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            out.append(whole[last:edges[lo]])
            last = edges[hi]
        texts[-1] = b"".join([*out, whole[last:words.offsets[k + 1]]])
    return texts, lost, keepers


def shortened(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that lose words: doc_id, n_removed, the documents that keep those passages, and the text that is left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, lost, keepers = _without(piece, min_words)
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(lost), pa.array(keepers, pa.list_(pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_removed", "kept_in", "text"]).filter(pa.array(lost > 0))

    joined = docs.join(repeats(docs, min_words), "doc_id")
    return by_batches(joined, run, "doc_id long, n_removed long, kept_in array<long>, text string")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with all their columns, without later repeats. Those that lose every word are left out."""
    names = docs.columns
    joined = docs.join(repeats(docs, min_words), "doc_id", "left").select(*names, _SPANS)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts, lost, _ = _without(piece, min_words)
        text = pa.array(texts, pa.binary()).cast(pa.string())
        columns = {name: piece.column(name) for name in names} | {"text": text}
        if "n_chars" in columns:
            own = columns["n_chars"]
            columns["n_chars"] = pa.compute.if_else(pa.array(lost > 0), pa.compute.utf8_length(text).cast(own.type), own)
        left = (lost == 0) | (find_words(text).counts() > 0)
        return pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(left))

    return by_batches(joined, run, T.StructType(docs.schema.fields))

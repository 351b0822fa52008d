"""Benchmark items inside documents: SimHash fingerprints of item-sized windows, then exact similarity of weighted shingles.

A window of as many words as an item has is compared with the items of that length. Windows enough of whose shingles occur in the
benchmark at all get a 64-bit fingerprint of their shingles. The fingerprint's 8 blocks of 8 bits are looked up in an index that
holds every item under all block values up to 2 bits away: two fingerprints that differ in at most 23 bits agree that far in one
block at least, so no such item is missed. Who stays within the radius is verified: the shingles of window and item, weighted by how
often each occurs, must have 80 % of their sum of maxima in their sum of minima. A document shorter than an item is one window itself, if it is long enough for 80 %.

With any_length, items that no such window matches are also compared with windows of all other lengths: where enough of their shingles lie close
together, an index from shingles to items names the candidates, and only windows that begin and end with a shingle of the item are tried.

The windows of one length in a piece of text go through each step together; they share running counts of their shingles' bits.

Words are lower-cased (A-Z). Items shorter than a shingle are one shingle of their own length. Documents are judged each by
itself, nothing is shuffled. The benchmark is taken in blocks of a fixed number of items, one pass over the documents for each.

Defined results: null and wordless texts match nothing; items without words are ignored, equal items are all reported; rows
with equal or no ids are judged each by itself; other columns are left alone.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.shared import by_batches
from gavelspark.llm.words import SHINGLE, find_words, mix, sequence_hashes

PERCENT = 80
RADIUS = 23
BLOCK_ITEMS = 20_000  # items held by each task at once
_BLOCKS = 8
_NEAR = [[x ^ d for d in range(256) if d.bit_count() <= RADIUS // _BLOCKS] for x in range(256)]
_CHUNK = 4096  # windows fingerprinted at once
_ENTRIES = 1 << 20  # entries of the index looked at at once, beyond those of one window
_TOKENS = 1 << 15  # tokens of windows whose bits are counted at once, beyond those of one window
_COMPARED = 1 << 20  # shingles of windows and items compared at once, beyond those of one pair
MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """One for each row of shingles: bit k is set if more of the row's shingles have it than not."""
    out = np.empty(len(shingles), np.uint64)
    for k in range(0, len(shingles), _CHUNK):
        part = shingles[k:k + _CHUNK]
        ones = np.zeros((len(part), 64), np.int32)
        for column in part.T:
            ones += np.unpackbits(np.ascontiguousarray(mix(column)).view(np.uint8).reshape(-1, 8), axis=1)
        out[k:k + _CHUNK] = np.packbits(2 * ones > part.shape[1], axis=1).view(np.uint64).ravel()
    return out


def window_fingerprints(tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The same for the windows of `size` tokens at each start (ascending): what a window has of a bit is the difference of two running counts."""
    out = np.empty(len(starts), np.uint64)
    new = np.minimum(np.diff(starts, prepend=starts[:1] - size), size)  # tokens that no window before has
    ends = np.cumsum(new)
    for lo, hi in _turns(ends, _TOKENS):
        at = np.concatenate([[0], np.cumsum(new[lo + 1:hi])])  # where windows begin among the tokens that they cover
        first = np.concatenate([[starts[lo]], starts[lo + 1:hi] + size - new[lo + 1:hi]])
        covered = _ranges(first, np.concatenate([[starts[lo] + size], starts[lo + 1:hi] + size]))
        ones = np.zeros((len(covered) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(mix(tokens[covered]).view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=ones[1:])
        out[lo:hi] = np.packbits(2 * (ones[at + size] - ones[at]) > size, axis=1).view(np.uint64).ravel()
    return out


def _turns(sums: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that add up to about `limit` each, one row at least, by the running sums."""
    return itertools.pairwise([0, *(np.flatnonzero(np.diff(sums // limit)) + 1).tolist(), len(sums)]) if len(sums) else iter(())


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from each begin up to its end, one range behind the other."""
    sizes = end - begin
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Length:
    """The items of one length: ids, shingles (one row each), fingerprints, and the index from block values to items."""

    ids: np.ndarray
    shingles: np.ndarray
    marks: np.ndarray
    index: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # for each block: where each value begins, and the items
    holders: tuple[np.ndarray, np.ndarray] = ()

    def __post_init__(self) -> None:
        held = np.unique(np.stack([self.shingles.ravel(), np.repeat(np.arange(len(self.ids), dtype=np.uint64), self.shingles.shape[1])]), axis=1)
        self.holders = held[0], held[1].astype(np.int64)  # by shingle, each item once
        values = self.marks.view(np.uint8).reshape(-1, _BLOCKS)
        for block in range(_BLOCKS):
            at = defaultdict(list)
            for item, value in enumerate(values[:, block].tolist()):
                for near in _NEAR[value]:
                    at[near].append(item)
            cuts = np.cumsum([0, *(len(at[value]) for value in range(256))])
            self.index.append((cuts, np.array([item for value in range(256) for item in at[value]], np.int64)))

    def within_radius(self, mark: np.uint64) -> np.ndarray:
        return np.array([item for _, items in self.near(np.array([mark], np.uint64)) for item in items.tolist()], np.int64)

    def near(self, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(mark, item) of all within the radius in that order, a bounded number of index entries at once."""
        values = marks.view(np.uint8).reshape(-1, _BLOCKS)
        entries = sum(np.diff(cuts)[values[:, block]] for block, (cuts, _) in enumerate(self.index))
        for lo, hi in _turns(np.cumsum(entries), _ENTRIES):
            met = []
            for block, (cuts, items) in enumerate(self.index):
                value = values[lo:hi, block].astype(np.int64)
                item = items[_ranges(cuts[value], cuts[value + 1])]
                mark = np.repeat(np.arange(lo, hi), cuts[value + 1] - cuts[value])
                close = np.bitwise_count(self.marks[item] ^ marks[mark]) <= RADIUS
                met.append(mark[close] * len(self.ids) + item[close])
            yield np.divmod(np.unique(np.concatenate(met)), len(self.ids))

    def sharing(self, shingles: np.ndarray, least: int) -> list[int]:
        """The items that hold at least so many of these shingles, repeats counted."""
        values, times = np.unique(shingles, return_counts=True)
        begin, end = (np.searchsorted(self.holders[0], values, side) for side in ("left", "right"))
        shared = np.bincount(self.holders[1][_ranges(begin, end)], np.repeat(times, end - begin), len(self.ids))
        return np.flatnonzero(shared >= least).tolist()


@dataclass
class Benchmark:
    """A block of items by length in words, and all their shingles by width."""

    lengths: dict[int, Length]
    known: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Benchmark:
        words = find_words(pa.array(texts, pa.string()), lower=True)
        begin = np.searchsorted(words.rows, np.arange(len(texts)))
        members = defaultdict(list)
        for row, n in enumerate(words.counts().tolist()):
            if n:
                members[n].append(row)
        lengths, known = {}, defaultdict(list)
        for n, rows in members.items():
            width = min(n, SHINGLE)
            first = begin[rows][:, None] + np.arange(n - width + 1)
            shingles = sequence_hashes(words.hashes, first.ravel(), width).reshape(first.shape)
            lengths[n] = Length(np.array([-1 if ids[r] is None else ids[r] for r in rows], np.int64), shingles, fingerprints(shingles))
            known[width].append(shingles.ravel())
        return cls(lengths, {width: np.unique(np.concatenate(parts)) for width, parts in known.items()})


def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and b, the sum of minima over the sum of maxima of how often each number occurs in it. Numbers below 0 are equal to no other."""
    values = max(a.max(initial=0), b.max(initial=0)) + 1
    rows = np.arange(len(a))[:, None] * values
    x, n_x = np.unique((rows + a)[a >= 0], return_counts=True)
    y, n_y = np.unique((rows + b)[b >= 0], return_counts=True)
    both, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.bincount(both // values, np.minimum(n_x[at_x], n_y[at_y]), len(a))
    return common / (a.shape[1] + b.shape[1] - common)


def find(column: pa.Array, benchmark: Benchmark, percent: int, any_length: bool = False) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of the best window for each row and item that match."""
    words = find_words(column, lower=True)
    begin = np.searchsorted(words.rows, np.arange(words.n_rows + 1))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for width, known in benchmark.known.items():
        first, shingles = words.shingles(width)
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        hit = np.zeros(len(words.hashes) + 1, np.int64)
        token = np.zeros(len(words.hashes), np.uint64)
        number = np.full(len(words.hashes), -1)  # of the shingle among the known ones
        hit[first + 1] = known[at] == shingles
        number[first] = np.where(hit[first + 1], at, -1)
        token[first] = shingles
        np.cumsum(hit, out=hit)
        n_words, n_hits = begin[1:] - begin[:-1], hit[begin[1:]] - hit[begin[:-1]]

        def match(starts: np.ndarray, n: int, size: int, items: Length) -> None:
            """The windows of n words and `size` shingles at these places (ascending)."""
            for windows, met in items.near(window_fingerprints(token, starts, size)):
                most = max(1, _COMPARED // (size + items.shingles.shape[1]))
                for k in range(0, len(met), most):
                    at, item = starts[windows[k:k + most]], met[k:k + most]
                    found = similarities(number[at[:, None] + np.arange(size)], np.searchsorted(known, items.shingles[item]))
                    good = 100 * found >= percent - 1e-9
                    at, row = at[good], words.rows[at[good]]
                    for i, j, similarity, place in zip(row.tolist(), items.ids[item[good]].tolist(), found[good].tolist(), (at - begin[row]).tolist(), strict=True):
                        if similarity > best.get((i, j), (0.0,))[0]:
                            best[i, j] = (similarity, place, n)

        for n, items in benchmark.lengths.items():
            if min(n, SHINGLE) != width:
                continue
            size = n - width + 1
            least = -(-2 * percent * size // (100 + percent))  # shared shingles that the similarity takes
            rows = np.flatnonzero((n_hits > 0) & (100 * n_hits >= percent * size))
            for row in rows[n_words[rows] < n].tolist():
                whole = int(n_words[row]) - width + 1
                if (100 + percent) * n_hits[row] >= percent * (size + whole):
                    match(begin[row:row + 1], whole + width - 1, whole, items)
            long = rows[(n_words[rows] >= n) & (n_hits[rows] >= least)]
            starts = _ranges(begin[long], begin[long + 1] - n + 1)
            match(starts[hit[starts + size] - hit[starts] >= least], n, size, items)
            if any_length:
                for row in rows.tolist():
                    _match_others(best, token, hit, row, int(begin[row]), int(begin[row + 1]), width, size, items, percent)
    return [(row, item, *rest) for (row, item), rest in sorted(best.items())]


def _match_others(
    best: dict, token: np.ndarray, hit: np.ndarray, row: int, lo: int, hi: int, width: int, size: int, items: Length, percent: int,
) -> None:
    """Windows of all lengths, for items that have no match in this row."""
    end = hi - width + 1
    most, least = min(100 * size // percent, end - lo), -(-percent * size // 100)
    starts = np.arange(lo, end - most + 1)
    starts = starts[hit[starts + most] - hit[starts] >= least]
    if not len(starts):
        return
    for near in np.split(starts, np.flatnonzero(np.diff(starts) > most) + 1):
        places = np.arange(near[0], near[-1] + most)
        places = places[hit[places + 1] > hit[places]]
        for k in items.sharing(token[places], least):
            key = (row, int(items.ids[k]))
            if key in best:
                continue
            wanted = Counter(items.shingles[k].tolist())
            own = [(at, value) for at, value in zip(places.tolist(), token[places].tolist(), strict=True) if value in wanted]
            found = (0.0, 0, 0)
            for i, (first, _) in enumerate(own):
                seen, common = Counter(), 0
                for last, value in itertools.islice(own, i, None):
                    if last - first >= most:
                        break
                    seen[value] += 1
                    common += seen[value] <= wanted[value]
                    similarity = common / (last - first + 1 + size - common)
                    if similarity > found[0]:
                        found = (similarity, first - lo, last - first + width)
            if 100 * found[0] >= percent - 1e-9:
                best[key] = found


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Benchmark]:
    ids, texts = [], []
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == size:
            yield Benchmark.of(ids, texts)
            ids, texts = [], []
    if ids:
        yield Benchmark.of(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_items: int = BLOCK_ITEMS, any_length: bool = False) -> DataFrame:
    """A row for each document and item that it contains, with the most similar window. An item without id has -1."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], MATCHES)
    for block in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(block)

        def run(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            got = find(piece.column("text"), shared.value, percent, any_length)
            rows, *rest = zip(*got, strict=True) if got else ([],) * 5
            types = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))],
                ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.union(by_batches(docs, run, MATCHES))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_items: int = BLOCK_ITEMS, any_length: bool = False) -> DataFrame:
    """The documents without any item, with all their columns."""
    for block in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            kept = np.ones(len(piece), bool)
            kept[[row for row, *_ in find(piece.column("text"), shared.value, percent, any_length)]] = False
            return piece.filter(pa.array(kept))

        docs = by_batches(docs, run, docs.schema)
    return docs

"""Words, lines and their hashes of whole Arrow string columns, as NumPy arrays.

A word is a run of characters other than space and U+0009..U+000D. These are single bytes in UTF-8 and never part of another
character, so everything here works on the bytes of a column without decoding it. Nulls count as empty texts.
Memory is about a hundred bytes for each byte of text, so callers go through a batch in `pieces` of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
PIECE_BYTES = 1 << 20

WORD_BYTES = (~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_PLACES = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Powers:
    up = down = _powers(1, 1)

    @classmethod
    def at_least(cls, n: int) -> type[_Powers]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls


@dataclass
class Words:
    """Words of a column of texts: first byte, byte after the last, row, and hash of each."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.n_rows)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans."""
        return mix((self.sums[ends] - self.sums[starts]) * _Powers.at_least(len(self.sums)).down[starts])

    def shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of `width` words within one row."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.rows[:n] == self.rows[width - 1:])
        return first, sequence_hashes(self.hashes, first, width)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` values that begin at each of `first`."""
    total = np.full(len(first), width, np.uint64)
    for k in range(width):
        total += hashes[first + k] * _PLACES[k]
    return mix(total)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column, and where each row begins (with the end as last)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, lower: bool = False, kinds: np.ndarray = WORD_BYTES) -> Words:
    """Runs of bytes of one kind; bytes of kind 0 are between words."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    kind = kinds[data]
    within = kind != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts, stops = np.flatnonzero(within & edge[:-1]), np.flatnonzero(within & edge[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    powers = _Powers.at_least(len(data) + 1)
    np.cumsum(_BYTE_VALUES[data] * powers.up[:len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * powers.down[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, offsets, starts, stops, rows, hashes, sums)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about `limit` bytes of text each, one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64) + 64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values (one for each byte) of each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Words of whole texts as 64-bit hashes, with numpy inside Spark tasks.

Texts come as Arrow batches of UTF-8. They are walked in slices of about CHUNK_BYTES, so memory follows the slice (or the
longest single text), not the batch. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes: bytes that belong to words. Upper-case A-Z belong as they are lower-cased first.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])[_LOWER]
VISIBLE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA3B195354A39B70D)
    return x ^ (x >> U64(32))


_CODE = mix(_LOWER.astype(np.uint64) + U64(1)) | U64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: bytes [begin, end) of `data`; text i has words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word; letters A-Z count as a-z."""
        out = np.empty(len(self.begin), np.uint64)
        lo = 0
        while lo < len(out):
            at = int(self.begin[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, at + CHUNK_BYTES, "right")))
            part = self.data[at : int(self.end[hi - 1])]
            power, inverse = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_CODE[part] * power[: len(part)], out=sums[1:])
            b = self.begin[lo:hi] - at
            out[lo:hi] = mix((sums[self.end[lo:hi] - at] - sums[b]) * inverse[b])
            lo = hi
        return out

    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo to hi in lower case, with one space between."""
        return b" ".join(bytes(_LOWER[self.data[self.begin[i] : self.end[i]]]) for i in range(lo, hi))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for runs of rows of at most `limit` bytes, or one row."""
    data, offsets = binary(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of texts: longest runs of bytes that `table` marks, never across texts."""
    inside = table[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    starts, stops = offsets[:-1], offsets[1:]
    some = stops > starts
    opens[starts[some]] = inside[starts[some]]
    closes[stops[some] - 1] = inside[stops[some] - 1]
    begin = np.flatnonzero(opens)
    return Words(data, offsets, begin, np.flatnonzero(closes) + 1, np.searchsorted(begin, offsets))


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and the offsets by text; a text of fewer words, but not none, is one run."""
    counts = np.diff(first)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(number)])
    if not offsets[-1]:
        return np.empty(0, np.uint64), offsets
    text = np.repeat(np.arange(len(counts)), number)
    at = first[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    last = first[1:][text] - 1
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k <= last
        out = np.where(there, (out + hashes[np.minimum(at + k, last)]) * _STEP + U64(k + 1), out)
    return mix(out), offsets

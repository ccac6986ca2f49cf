"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. All of it works on the UTF-8 bytes of many texts at
once: none of the separators occurs inside a multi-byte character. Hashes are 64-bit, seeded, and equal
in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; keeps working arrays in cache and memory bounded by the longest text.
SLICE_BYTES = 1 << 21

_BASE, _BASE_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def _powers(base: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << exponent
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(21, int(n + 1).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]``; the position does not matter."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of a slice of texts: ``doc`` (index of the text), ``start``/``end`` (bytes in ``data``), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        word = ~space
        first, last = word[1:-1] & space[:-2], word[1:-1] & space[2:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] |= word[inner + 1]
        last[inner - 1] |= word[inner]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)  # index of each text's first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        if hashes:
            self.hash = mix(span_hashes(_VALUES[_LOWER[data] if lower else data], self.start, self.end, _BASE))

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, size: int, whole_if_shorter: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(text index, hash) of each window of ``size`` words; a shorter text with words is one window."""
        h = self.hash
        if len(h) >= size:
            n = len(h) - size + 1
            out = h[:n] * np.uint64(0x9FB21C651E98DF25)
            for k in range(1, size):
                out = mix(out) + h[k : k + n] * np.uint64(0xA24BAED4963EE407)
            whole = self.doc[:n] == self.doc[size - 1 :]
            docs, out = self.doc[:n][whole], mix(out)[whole]
        else:
            docs, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if whole_if_shorter and len(short := np.flatnonzero((self.counts > 0) & (self.counts < size))):
            parts = span_hashes(h, self.first[short], self.first[short + 1], _BASE_WORDS)
            docs = np.concatenate([docs, short])
            out = np.concatenate([out, mix(parts ^ self.counts[short].astype(np.uint64))])
        return docs, out

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences ``[start, end)``, given as word indices."""
        return mix(span_hashes(self.hash, starts, ends, _BASE_WORDS))


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``limit`` bytes of text; every row is in one run."""
    if not batch.num_rows:
        return
    column = text_column(batch, text)
    data, offsets = raw(column)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, batch.num_rows)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def group_sum64(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by index, modulo 2**64; exact for any number of values below 2**37."""
    width = 32 if len(values) <= 1 << 21 else 16  # partial sums stay below 2**53, where doubles are exact
    total, mask = np.zeros(n, np.uint64), np.uint64((1 << width) - 1)
    for shift in range(0, 64, width):
        part = np.bincount(index, ((values >> np.uint64(shift)) & mask).astype(np.float64), n)
        total += part.astype(np.uint64) << np.uint64(shift)
    return total

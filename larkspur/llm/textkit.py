"""Whole-array text work inside tasks: Arrow string columns in, word positions and hashes out.

Words are found on UTF-8 bytes. That is exact, because every separator is an ASCII byte and no byte
of a longer character is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone and whole.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_WHITE = [0x20, *range(0x09, 0x0E)]
_NOT_WORDY = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


def _table(members: list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[members] = True
    return out


#: Separators of words [^\x20\x09-\x0D]+
WHITESPACE = _table(_WHITE)
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NON_ALPHANUMERIC = _table(_NOT_WORDY)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size, at least."""
    return _powers(CHUNK + 1 if size <= CHUNK + 1 else 1 << (size - 1).bit_length())


@dataclass
class Words:
    """Words of a chunk, in order: byte ranges, the text each is in, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text, and the total last

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = powers(n + 1)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def of(self, i: int) -> list[bytes]:
        """The words of text i."""
        return [self.data[s:e].tobytes() for s, e in zip(*(x[self.first[i] : self.first[i + 1]] for x in (self.start, self.end)))]


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> Words:
    """The maximal runs of bytes that are no separators, within each text of offsets."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    opens, closes = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    opens[1:] = ~inside[:-1]
    closes[:-1] = ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = True
    closes[edges - 1] = True
    start = np.flatnonzero(inside & opens)
    end = np.flatnonzero(inside & closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, doc, first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about limit bytes at most."""
    limit = limit or CHUNK
    data, offsets = text_buffers(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def string_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same in every column."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets[:-1], offsets[1:], np.zeros(0, np.int64), np.zeros(0, np.int64))
    return words.hashes()


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0]-1, 0 .. counts[1]-1 and so on, in one array."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: list i holds values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))

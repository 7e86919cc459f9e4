"""Words of a batch of texts as NumPy arrays, without a Python loop over rows or words.

A text is taken as its UTF-8 bytes. A *word* is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII
characters; a *mark* is a maximal run of other bytes that aren't white space or control characters. Hashes are
polynomial over the run's bytes modulo 2**64, then mixed, and depend on nothing but those bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD, MARK = 1, 2
_CLASS = np.full(256, MARK, dtype=np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n at least, modulo 2**64; kept by the worker process."""
    held = _POWERS.get("p")
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _P), ("q", _P_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[key] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def trim() -> None:
    """Gives back what a finished task has freed: workers live on, and the next task's memory comes beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in ascending order; sorting is several times faster than ``np.unique`` here."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    p, q = powers(len(h) + 1)
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * p[: len(h)], out=s[1:])
    return mix((s[k:] - s[:-k]) * q[: len(h) - k + 1])


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len + 1 offsets into them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    data, offsets = raw(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


class Runs:
    """The words, and with ``marks`` the marks, of some texts: byte bounds, text number and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, marks: bool = False):
        n = len(data)
        kind = _CLASS[data]
        if not marks:
            kind = (kind == WORD).view(np.uint8)
        edge = np.empty(n, dtype=bool)
        edge[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        heads = offsets[:-1]
        edge[heads[heads < n]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        held = kind[start] > 0
        self.start, self.end = start[held], end[held]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        if fold:
            data = _LOWER[data]
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # letters À to Þ
            up = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
            data[up] += 0x20
        p, q = powers(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=s[1:])
        self.hash = mix((s[self.end] - s[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))
        #: first run of each text, and one past the last of all
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))

    def __len__(self) -> int:
        return len(self.start)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum over values[first[i]:first[i+1]] for each i; 0 for an empty range."""
    s = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=s[1:])
    return s[first[1:]] - s[first[:-1]]

"""Whole Arrow batches of text as numpy arrays: word borders and 64-bit word hashes without a loop over words.

Work goes over slices of documents of about ``SLICE`` bytes, so temporary arrays stay small however large a batch is;
only a single longer document makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_U = np.uint64
_BASE, _LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: True for bytes of a word, that is for all but ASCII white space; bytes of longer UTF-8 characters are word bytes
IN_WORD = np.ones(256, bool)
IN_WORD[list(SPACES)] = False
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's last step)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, SLICE + 1)
        for side, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _LOW, np.uint64)
            steps[0] = 1
            _powers[side] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one after the other, and the n + 1 borders; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, borders, data = column.buffers()
    at = np.frombuffer(borders, np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(borders: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""
    low, n = 0, len(borders) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(borders, borders[low] + size, "right")) - 1)
        yield low, high
        low = high


def spans(raw: np.ndarray, borders: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in ``raw``, and the borders of the documents counted in words."""
    word = inside[raw]
    first, last = word.copy(), word.copy()
    if len(raw):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        filled = borders[1:] > borders[:-1]
        starts, stops = borders[:-1][filled], borders[1:][filled] - 1
        first[starts], last[stops] = word[starts], word[stops]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, borders)


def hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of every span; equal bytes after ``fold`` give equal hashes wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[fold[raw]] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

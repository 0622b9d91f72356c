"""Vectorised word work on Arrow string columns.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; as these are ASCII, UTF-8 text can be
split on its bytes. Texts are walked in blocks of about ``BLOCK`` bytes, so memory is bounded by the
block or by one row, whichever is larger. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_CHUNK = 1 << 17
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, _CHUNK + 1)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` for spans with ascending starts and ends, by prefix sums of a
    polynomial over the ring of 64-bit integers."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = int(ends[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[lo:hi] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Block:
    """Some rows' bytes, each row preceded by one space, with the bounds of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.rows = first, len(offsets) - 1
        lengths = np.diff(offsets)
        self.row_start = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the space before each row
        self.data = np.insert(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], 32)
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(self.data) and not space[-1]:
            edge = np.append(edge, len(self.data))
        # the first byte is a space, so edges alternate; a row's leading space parts it from the last row
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.word_at = np.searchsorted(self.starts, self.row_start)  # first word of each row
        self.n_words = np.diff(self.word_at)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_hashes(_BYTE[data], self.starts, self.ends) if len(self.starts) < 1 else _chunked(data, self.starts, self.ends)


def _chunked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hashes over _BYTE[data], without holding 8 bytes for each byte of the block."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = int(ends[j - 1])
        out[i:j] = span_hashes(_BYTE[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The rows of a string column in order, in blocks of about ``size`` bytes."""
    data, offsets = column_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + size // 16)
        yield Block(data, offsets[i : j + 1], i)
        i = j


def ngram_hashes(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries (whatever row they are of)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    q, out = _U(factor), words[:m].copy()
    for k in range(1, n):
        out *= q
        out += words[k : m + k]
    return mix(out)

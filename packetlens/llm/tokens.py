"""Words of whole texts as numpy arrays, a piece of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece holds whole texts of about so many bytes, or one longer text.
PIECE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(256)


@dataclass
class Piece:
    """Words of some whole texts. ``first`` has the index of each text's first word, and the number of words last."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased unless ``lower`` is false."""
        global _POWERS
        lens = self.ends - self.starts
        if not len(lens):
            return np.empty(0, np.uint64)
        if lens.max() > len(_POWERS):
            _POWERS = _powers(int(lens.max()))
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        inside = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin, lens)
        at = inside + np.repeat(self.starts, lens)
        with np.errstate(over="ignore"):
            data = LOWER[self.data[at]] if lower else self.data[at]
            h = np.add.reduceat(_BYTE[data] * _POWERS[inside], begin)
            return mix64(h + lens.astype(np.uint64) * _ODD)

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def pieces(column: pa.Array) -> Iterator[Piece]:
    """Splits a string column by whole texts; null texts are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
        end = min(n, max(at + 1, end))
        yield _piece(slice(at, end), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def _piece(rows: slice, data: np.ndarray, offsets: np.ndarray) -> Piece:
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], ink])[:-1] if len(data) else ink
    after = np.concatenate([ink, [False]])[1:] if len(data) else ink
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return Piece(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets, "left"))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of one text, and the index of the text of each."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.repeat(first[:-1], n)
    return gram_hash([hashes[at + j] for j in range(k)]), text


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(words[0]), np.uint64(len(words)) * _ODD, np.uint64)
        for w in words:
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + w)
        return h


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (any number of columns) over the segments that ``first`` bounds; 0 for empty ones."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]

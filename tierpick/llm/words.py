"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow columns with numpy.

A column of texts is worked on as one array of bytes. A word's hash is a sum
of byte codes times powers of an odd number modulo 2^64, taken from prefix
sums, and scrambled; a shingle's hash combines those of its words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 1 << 20
SLICE_ROWS = 1000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all (splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _codes() -> np.ndarray:
    return scramble(np.arange(1, 257, dtype=_U) * _U(_BASE))


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def blanks() -> np.ndarray:
    """Separators of words: space and 0x09-0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_alphanumeric() -> np.ndarray:
    """Separators: every ASCII character that is neither letter nor digit."""
    table = np.zeros(256, dtype=bool)
    table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


class Reader:
    """Cuts texts into words; keeps the tables that all texts share."""

    def __init__(self, separators: np.ndarray | None = None, fold_latin: bool = False):
        self.lower = lower_ascii()
        self.separators = blanks() if separators is None else separators
        self.fold_latin = fold_latin
        self.codes = _codes()
        self.factors = scramble(np.arange(101, 101 + SHINGLE, dtype=_U)) | _U(1)
        self._powers(CHUNK_BYTES)

    def _powers(self, n: int):
        inverse = pow(_BASE, -1, 1 << 64)
        self.power = np.cumprod(np.full(n, _BASE, dtype=_U)) * _U(inverse)
        self.back = np.cumprod(np.full(n, inverse, dtype=_U)) * _U(_BASE)

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Word hashes, starts and ends in bytes, and the first word of each text."""
        n = len(data)
        if n > len(self.power):
            self._powers(n)
        low = self.lower[data]
        if self.fold_latin:  # É and é differ in one bit of their second byte
            upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:][upper & (data[:-1] == 0xC3)] += 32
        inside = ~self.separators[low]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[:-1]] = True  # texts meet here
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        sums = self.codes[low]
        sums *= self.power[:n]
        np.cumsum(sums, out=sums)
        hashes = sums[ends]
        before = sums[starts - 1]
        if len(starts) and starts[0] == 0:
            before[0] = 0
        hashes -= before
        hashes *= self.back[starts]
        hashes = scramble(hashes ^ ((ends - starts).astype(_U) << _U(40)))
        return hashes, starts, ends + 1, np.searchsorted(starts, offsets)

    def shingles(self, words: np.ndarray, bounds: np.ndarray, size: int = SHINGLE):
        """Shingle hashes in order of place, and the first shingle of each text.

        A text with fewer words than a shingle gives all its words as one.
        """
        counts = np.diff(bounds)
        full = np.maximum(counts - size + 1, 0)
        many = np.where(counts > 0, np.maximum(full, 1), 0)
        at = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(many, out=at[1:])
        out = np.zeros(at[-1], dtype=_U)
        if len(words) >= size:
            rolled = np.full(len(words) - size + 1, size, dtype=_U)
            for k in range(size):
                rolled += words[k:len(words) - size + 1 + k] * self.factors[k]
            keep = np.repeat(bounds[:-1] - at[:-1], full) + _places(at[:-1], full)
            out[_places(at[:-1], full)] = rolled[keep]
        for i in np.flatnonzero((counts > 0) & (full == 0)):
            part = words[bounds[i]:bounds[i + 1]]
            with np.errstate(over="ignore"):
                out[at[i]] = (part * self.factors[:len(part)]).sum(dtype=_U) + _U(len(part))
        return scramble(out), at

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows of a text column in pieces: first row, bytes, offsets of the texts."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        for first in range(0, len(column), SLICE_ROWS):
            part = column.slice(first, SLICE_ROWS).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[
                part.offset:part.offset + len(part) + 1]
            buffer = part.buffers()[2]
            data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
            row = 0
            while row < len(part):
                stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
                stop = min(max(stop, row + 1), len(part))
                yield (first + row, data[offsets[row]:offsets[stop]],
                       offsets[row:stop + 1] - offsets[row])
                row = stop


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... as many as counts[0], then the same for the next."""
    total = int(counts.sum())
    skipped = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(first - skipped, counts)

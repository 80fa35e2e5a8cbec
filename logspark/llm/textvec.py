"""Words and word n-grams of many texts at once, as numpy arrays of 64-bit hashes.

Texts come as an Arrow column and are worked on in pieces of a few megabytes, so a task holds a bounded
amount of working memory beside its largest single text. Hashes depend on the text alone, never on the
process, so they can be grouped and joined across executors and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_space = np.zeros(256, bool)
_space[list(SPACES)] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values: an invertible map of which every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(n, base)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets where each begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)), offsets


class Piece:
    """Some consecutive texts: ``first`` is the row of the first, ``data`` their bytes, ``offsets`` their bounds."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1

    def words(self, lower: bool = True, space: np.ndarray = _space, latin: bool = False) -> None:
        """Lower A-Z (with ``latin`` also accented Latin-1 capitals) and set ``starts`` and ``ends`` of all words, their ``hashes``, the ``row`` of each, and per row the bounds ``at`` of its words."""
        data = _lower[self.data] if lower else self.data
        if latin and len(data):
            second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
            data[1:][second] += 0x20
        gap = space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:] = gap[:-1] | edge[1:-1]
        after[:-1] = gap[1:] | edge[1:-1]
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.at = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.at))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a text, and the index of the first word of each."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.row[:count] == self.row[n - 1 :])
        return combine(self.hashes, n)[first], first


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive hashes."""
    count = len(hashes) - n + 1
    out = np.full(max(count, 0), np.uint64(n))
    for k in range(n):
        out = (out * BASE) ^ hashes[k : k + count]
        out = mix(out)
    return out


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of an Arrow column in order, in pieces of about ``limit`` bytes (a longer text is a piece alone)."""
    data, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield Piece(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end

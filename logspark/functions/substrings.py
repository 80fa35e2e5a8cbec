"""Which of many keywords may occur in texts: rolling hashes against bit filters, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bits of one block of a filter, as the executors make it.
BLOCK = 1 << 17
#: Bytes of text searched at once (a longer text is searched alone).
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The probes of a whole keyword are its hash times each of these.
PROBES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(n, base)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets where each begins and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8), offsets


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`_hashes` takes the hash of any stretch."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up_down(len(data) + 1)[0][:-1], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (total[end] - total[start]) * _up_down(len(total))[1][start]


def _beginning(size: np.ndarray) -> np.ndarray:
    """The greatest power of two up to each size."""
    return 1 << (np.frexp(size.astype(np.float64))[1] - 1)


def slots(keywords: int, most: int) -> int:
    """Bits of each filter: a power of two, 16 to 32 a keyword, and at most ``most``."""
    wanted = 1 << max(keywords * 16, BLOCK).bit_length()
    return max(min(wanted, 1 << (max(most, 2).bit_length() - 1)), 1 << 10)


def bit_blocks(keywords: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and place in it of every bit that ``keywords`` set; the blocks of the filter of whole keywords have numbers below zero."""
    blocks, places = [], []
    data, offsets = _flat(keywords)
    row = 0
    while row < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1, row + 1)
        total = _sums(data[offsets[row] : offsets[end]])
        start, stop = offsets[row:end] - offsets[row], offsets[row + 1 : end + 1] - offsets[row]
        shift = np.uint64(65 - bits.bit_length())
        first = _hashes(total, start, start + _beginning(stop - start)) >> shift
        whole = _hashes(total, start, stop)
        second = np.concatenate([(whole * p) >> shift for p in PROBES])
        blocks += [(first // np.uint64(BLOCK)).astype(np.int64), -1 - (second // np.uint64(BLOCK)).astype(np.int64)]
        places += [first % np.uint64(BLOCK), second % np.uint64(BLOCK)]
        row = end
    return np.concatenate([np.zeros(0, np.int64), *blocks]), np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)


class KeywordFilter:
    """Beginnings and whole forms of keywords as bits. ``sizes`` are the keywords' lengths in bytes, ``bits`` those of each filter."""

    def __init__(self, sizes: list[int], bits: int, blocks: list[tuple[int, bytes]]):
        self.shift = np.uint64(65 - bits.bit_length())
        self.first, self.whole = (np.zeros(max(bits // 8, BLOCK // 8), np.uint8) for _ in range(2))
        for block, packed in blocks:
            own, at = (self.first, block) if block >= 0 else (self.whole, -1 - block)
            own[at * BLOCK // 8 : (at + 1) * BLOCK // 8] = np.frombuffer(packed, np.uint8)
        self.sizes: dict[int, list[int]] = {}
        for size in sizes:
            self.sizes.setdefault(1 << (size.bit_length() - 1), []).append(size)

    @staticmethod
    def packed(at: np.ndarray) -> bytes:
        bits = np.zeros(BLOCK, bool)
        bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def _set(self, own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of all stretches that may be keywords, none across the texts' bounds ``offsets``."""
        total, down = _sums(data), _up_down(len(data) + 1)[1]
        for beginning, sizes in self.sizes.items():
            count = len(data) - beginning + 1
            if count <= 0:
                continue
            start = np.flatnonzero(self._set(self.first, (total[beginning:] - total[:count]) * down[:count]))
            limit = offsets[np.searchsorted(offsets, start, "right")] if len(start) else start
            for size in sizes:
                at = start[start + size <= limit]
                hashes = _hashes(total, at, at + size)
                for p in PROBES:
                    some = self._set(self.whole, hashes * p)
                    at, hashes = at[some], hashes[some]
                yield at, at + size

    def found(self, texts: pa.Array) -> Iterator[tuple[int, str]]:
        """Number of the text and the text of each stretch that may be a keyword: every keyword that occurs, and a few others."""
        data, offsets = _flat(texts)
        row = 0
        while row < len(offsets) - 1:
            end = max(int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1, row + 1)
            own, bounds = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            raw = own.tobytes()
            for start, stop in self.stretches(own, bounds):
                rows = np.searchsorted(bounds, start, "right") - 1 + row
                for k, a, b in zip(rows.tolist(), start.tolist(), stop.tolist(), strict=True):
                    # a hash may pass by chance in the middle of a character
                    yield k, raw[a:b].decode("utf-8", "replace")
            row = end

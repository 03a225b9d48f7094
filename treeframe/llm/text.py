"""Numpy over Arrow string buffers: words, rolling hashes, and cutting batches by bytes.

All functions look at the UTF-8 bytes of a batch as one array and treat each document as the
slice between two offsets, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: a random 64-bit number for each byte value
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

#: bytes that separate words: ASCII white space
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: bytes that separate normalised words: everything in ASCII but letters and digits
MARK = np.ones(256, bool)
MARK[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    MARK[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null has no bytes. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    valid = np.asarray(column.is_valid())
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within the limit; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.empty(size, U64)
            p[0] = 1
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * U64(pow(b, k, 2**64))
                k *= 2
            both.append(p)
        have = (both[0], both[1])
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    power, inverse = _powers(n + 1, base)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * power[:n], out=sums[1:])
    return sums, inverse


class Rolling:
    """Hashes of any slices of an array of numbers, from one pass of prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        self.sums, self.inverse = _prefix(_BYTE[values] if values.dtype == np.uint8 else values, base)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def word_hashes(values: np.ndarray, second: bool = False) -> Rolling:
    """Rolling hashes over an array of word hashes; the second has an independent base."""
    return Rolling(mix(values + U64(0x2545F4914F6CDD1D)) if second else values, 0xA0761D6478BD642F if second else _WORD_BASE)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows): byte ranges of the words, and for each document the number of its first word."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, byte for byte."""
    low = _LOWER[data]
    if len(data) > 1 and (data >= 128).any():
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][latin] += 32
    return low


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, its leftmost position) of each window of the width."""
    best, at, w = values, np.arange(len(values), dtype=np.int32), 1

    def join(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = best[:size], best[shift : shift + size]
        left = a <= b
        return np.where(left, a, b), np.where(left, at[:size], at[shift : shift + size])

    while 2 * w <= width:
        best, at = join(w, len(values) - 2 * w + 1)
        w *= 2
    if w < width:
        best, at = join(width - w, len(values) - width + 1)
    return best, at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)

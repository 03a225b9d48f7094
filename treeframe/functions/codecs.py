"""Byte codecs: bytes to bytes, each with its inverse.

Every codec is lossless on every input, the empty one included. Loops run over tokens or symbols of one
page; whatever can be done for a page at once is done in numpy.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable

import numpy as np


def delta_compress(data: bytes) -> bytes:
    """The first byte, then differences modulo 256."""
    a = np.frombuffer(data, np.uint8)
    return np.diff(a, prepend=np.uint8(0)).tobytes() if len(a) else b""


def delta_decompress(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).tobytes()


def rle_compress(data: bytes) -> bytes:
    """Pairs of run length, 1 to 255, and byte; longer runs are split."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[start, len(a)])
    parts = -(-size // 255)
    lengths = np.full(int(parts.sum()), 255, np.int64)
    lengths[np.cumsum(parts) - 1] = size - 255 * (parts - 1)
    return np.stack([lengths.astype(np.uint8), np.repeat(a[start], parts)], axis=1).tobytes()


def rle_decompress(data: bytes) -> bytes:
    if len(data) % 2:
        raise ValueError("run-length data has an even number of bytes")
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


#: LZ77: how far back a match may begin, its most bytes, its fewest, and places remembered for each 3 bytes
WINDOW, LOOKAHEAD, SHORTEST, PLACES = 4096, 18, 3, 8


def lz77_compress(data: bytes, window: int = WINDOW, lookahead: int = LOOKAHEAD) -> bytes:
    """Tokens 01 byte, and 00 distance (2 bytes, the higher first) length.

    Greedy; of the last places with the same 3 bytes the nearest of the longest matches is taken; places
    inside a match aren't remembered. A match may run into itself.
    """
    if not (0 < window <= 65_535 and SHORTEST <= lookahead <= 255):
        raise ValueError("window is at most 65,535, look-ahead 3 to 255")
    out = bytearray()
    seen: dict[bytes, list[int]] = {}
    n, i = len(data), 0
    while i < n:
        key = data[i : i + SHORTEST]
        places = seen.get(key) if len(key) == SHORTEST else None
        best, at = 0, 0
        if places:
            most = min(lookahead, n - i)
            for p in reversed(places):
                if i - p > window:
                    break
                if best and data[p + best] != data[i + best]:
                    continue
                k = SHORTEST
                while k < most and data[p + k] == data[i + k]:
                    k += 1
                if k > best:
                    best, at = k, p
                    if k == most:
                        break
        if len(key) == SHORTEST:
            if places is None:
                seen[key] = [i]
            else:
                places.append(i)
                if len(places) > PLACES:
                    del places[0]
        if best >= SHORTEST:
            d = i - at
            out += bytes((0, d >> 8, d & 255, best))
            i += best
        else:
            out += bytes((1, data[i]))
            i += 1
    return bytes(out)


def lz77_decompress(data: bytes) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        if data[i] == 1:
            out.append(data[i + 1])
            i += 2
        elif data[i] == 0:
            distance, size = data[i + 1] << 8 | data[i + 2], data[i + 3]
            begin = len(out) - distance
            if begin < 0 or not distance:
                raise ValueError("a match begins before the data")
            if distance >= size:
                out += out[begin : begin + size]
            else:
                piece = bytes(out[begin:])
                out += (piece * (size // distance + 1))[:size]
            i += 4
        else:
            raise ValueError("unknown token")
    return bytes(out)


def _bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of some bits each, one after the other, highest bit first."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    if not total or int(lengths.max()) > 32:
        bit = np.arange(total) - np.repeat(begin, lengths)
        shift = np.repeat(lengths, lengths) - 1 - bit
        return np.packbits(((np.repeat(values, lengths) >> shift) & 1).astype(np.uint8)).tobytes()
    # each number lies in two words of 32 bits at most; those that begin in the same one have no bit in common
    own = lengths > 0
    begin, lengths = begin[own], lengths[own]
    both = values[own].astype(np.uint64) << (64 - (begin & 31) - lengths).astype(np.uint64)
    word = begin >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums, word = np.bitwise_or.reduceat(both, first), word[first]
    out = np.zeros(int(word[-1]) + 2, np.uint32)
    out[word] = sums >> np.uint64(32)
    out[word + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: -(-total // 8)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's optimal prefix code; equal counts go by symbol."""
    heap = [(int(c), s, (s,)) for s, c in enumerate(counts) if c]
    lengths = np.zeros(len(counts), np.int64)
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        both = a[2] + b[2]
        lengths[list(both)] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
    return lengths


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols by length and number, their codes)."""
    symbols = np.lexsort((np.arange(len(lengths)), lengths))
    symbols = symbols[lengths[symbols] > 0]
    codes, code, last = [], 0, 0
    for s in symbols.tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes.append(code)
        code += 1
    return symbols, np.array(codes, np.int64)


def huffman_compress(data: bytes) -> bytes:
    """Number of bytes (4, little-endian), of symbols less one, their code lengths, the codes, which are canonical.

    Lengths are pairs with their symbol up to 128 symbols, else all 256.
    """
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    lengths = code_lengths(np.bincount(a, minlength=256))
    symbols, codes = _canonical(lengths)
    table = np.zeros(256, np.int64)
    table[symbols] = codes
    few = np.flatnonzero(lengths)
    sizes = np.stack([few, lengths[few]], axis=1) if len(few) <= 128 else lengths
    return struct.pack("<IB", len(a), len(few) - 1) + sizes.astype(np.uint8).tobytes() + _bits(table[a], lengths[a])


def huffman_decompress(data: bytes) -> bytes:
    if not data:
        return b""
    n, k = struct.unpack_from("<IB", data)
    at = 5 + (2 * (k + 1) if k < 128 else 256)
    stored = np.frombuffer(data, np.uint8, at - 5, 5).astype(np.int64)
    if k < 128:
        lengths = np.zeros(256, np.int64)
        lengths[stored[::2]] = stored[1::2]
    else:
        lengths = stored
    symbols, codes = _canonical(lengths)
    wide = int(lengths.max())
    if wide <= 20:
        return _prefix_decode(np.frombuffer(data, np.uint8, offset=at), n, wide, symbols, codes, lengths)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at))
    # by length: the first code of it, and where its symbols begin
    by_length: dict[int, tuple[int, int]] = {}
    at = 0
    for size in range(1, wide + 1):
        k = int((lengths == size).sum())
        if k:
            by_length[size] = int(codes[at]), at
        at += k
    counts = np.bincount(lengths[lengths > 0], minlength=257).tolist()
    out, i, stream = bytearray(), 0, bits.tolist()
    while len(out) < n:
        code, size = 0, 0
        while True:
            code = code << 1 | stream[i]
            i, size = i + 1, size + 1
            if size in by_length:
                first, begin = by_length[size]
                if 0 <= code - first < counts[size]:
                    out.append(int(symbols[begin + code - first]))
                    break
    return bytes(out)


def _prefix_decode(stream: np.ndarray, n: int, wide: int, symbols: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """n symbols of codes of at most 20 bits, in numpy but for one step of a loop for every 8 symbols."""
    size = 8 * len(stream)
    ahead = np.r_[stream, np.zeros(4, np.uint8)].astype(np.uint32)
    four = ahead[:-4] << 24 | ahead[1:-3] << 16 | ahead[2:-2] << 8 | ahead[3:-1]
    # the code that would begin at every bit
    window = np.empty((len(stream), 8), np.uint32)
    for k in range(8):
        window[:, k] = four >> (32 - wide - k)
    window &= (1 << wide) - 1
    window = window.ravel()
    symbol, step = np.zeros(1 << wide, np.uint8), np.ones(1 << wide, np.uint8)
    for s, c in zip(symbols.tolist(), codes.tolist()):
        spare = wide - int(lengths[s])
        symbol[c << spare : (c + 1) << spare] = s
        step[c << spare : (c + 1) << spare] = lengths[s]
    # by bit: where the next code begins, and the eighth from there on
    after = np.arange(size + 1, dtype=np.int32 if size < 1 << 30 else np.int64)
    after[:-1] += step[window]
    np.minimum(after, size, out=after)
    eighth = after[after]
    eighth = eighth[eighth]
    eighth = memoryview(eighth[eighth])
    place, begun = 0, []
    for _ in range(-(-n // 8)):
        begun.append(place)
        place = eighth[place]
    places = np.empty((len(begun), 8), np.int64)
    places[:, 0] = begun
    for k in range(1, 8):
        places[:, k] = after[places[:, k - 1]]
    # past the end of cut data there is no window: an IndexError
    return symbol[window[places.ravel()[:n]]].tobytes()


#: tANS: logarithm of the table's size
_LEAST_LOG, _MOST_LOG = 5, 11


def normalised_counts(counts: np.ndarray, log: int) -> np.ndarray:
    """Counts in proportion that add up to 2^log, at least 1 for each symbol that occurs."""
    total, size = int(counts.sum()), 1 << log
    exact = counts * (size / total)
    out = np.where(counts > 0, np.maximum(1, np.floor(exact + 0.5)), 0).astype(np.int64)
    # the remainder goes where it costs least: to or from the most frequent
    rest = size - int(out.sum())
    while rest:
        top = int(np.argmax(out))
        step = rest if rest > 0 else max(rest, -(int(out[top]) // 2))
        out[top] += step
        rest -= step
    return out


def _tans(counts: np.ndarray, log: int) -> np.ndarray:
    """The symbol of each state: places are strewn by a step that is prime to the table's size."""
    size = 1 << log
    place = np.arange(size) * ((size >> 1) + (size >> 3) + 3) & (size - 1)
    spread = np.empty(size, np.int64)
    spread[place] = np.repeat(np.arange(len(counts)), counts)
    return spread


def fse_compress(data: bytes) -> bytes:
    """Finite-state entropy with two states in turn.

    Mode 0 and the bytes, where coding gains nothing; mode 1, number and the only byte; mode 2, number,
    logarithm of the table, symbols less one, (symbol, normalised count of 2 bytes) each, two last states
    (2 bytes each), bits of the stream (4), and the stream, read backwards.
    """
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    counts = np.bincount(a, minlength=256)
    present = np.flatnonzero(counts)
    if len(present) == 1:
        return b"\x01" + struct.pack("<IB", n, present[0])
    log = min(_MOST_LOG, max(_LEAST_LOG, (n - 1).bit_length() - 1, int(len(present) - 1).bit_length()))
    norm = normalised_counts(counts, log)
    size = 1 << log
    spread = _tans(norm, log)
    # for each symbol, in order of states, the states that stand for it
    states = np.argsort(spread, kind="stable")
    first = np.cumsum(norm) - norm
    # state x in [size, 2 size): leave bits until it is in [count, 2 count), then go to the symbol's state
    most = [int(log - (int(c).bit_length() - 1)) if c else 0 for c in norm]
    bound = [int(c) << k for c, k in zip(norm.tolist(), most)]
    table, base, own = (states + size).tolist(), first.tolist(), norm.tolist()
    x = [size, size]
    values, widths = [], []
    for i in range(n - 1, -1, -1):
        s = data[i]
        y = x[i & 1]
        k = most[s] if y >= bound[s] else most[s] - 1
        values.append(y & ((1 << k) - 1))
        widths.append(k)
        x[i & 1] = table[base[s] + (y >> k) - own[s]]
    widths.reverse()
    values.reverse()
    stream = _bits(np.array(values, np.int64), np.array(widths, np.int64))
    head = b"\x02" + struct.pack("<IBB", n, log, len(present) - 1) + b"".join(struct.pack("<BH", s, norm[s]) for s in present.tolist())
    out = head + struct.pack("<HH", x[0] - size, x[1] - size) + stream
    return out if len(out) <= n else b"\x00" + data


def fse_decompress(data: bytes) -> bytes:
    if not data:
        return b""
    if data[0] == 0:
        return data[1:]
    if data[0] == 1:
        n, s = struct.unpack_from("<IB", data, 1)
        return bytes([s]) * n
    n, log, k = struct.unpack_from("<IBB", data, 1)
    at = 7
    norm = np.zeros(256, np.int64)
    for _ in range(k + 1):
        s, c = struct.unpack_from("<BH", data, at)
        norm[s] = c
        at += 3
    x = list(struct.unpack_from("<HH", data, at))
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 4))
    spread = _tans(norm, log)
    order = np.argsort(spread, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rank = norm[spread] + place - (np.cumsum(norm) - norm)[spread]
    width = log - (np.frexp(rank.astype(float))[1] - 1)
    symbol, widths, base = spread.tolist(), width.tolist(), ((rank << width) - (1 << log)).tolist()
    # the number that the next bits make, for any width up to the table's logarithm
    padded = np.r_[bits, np.zeros(log, np.uint8)].astype(np.int64)
    window = np.zeros(len(bits) + 1, np.int64)
    for j in range(log):
        window[: len(bits)] = window[: len(bits)] << 1 | padded[j : j + len(bits)]
    ahead = window.tolist()
    out, p = bytearray(n), 0
    for i in range(n):
        y = x[i & 1]
        out[i] = symbol[y]
        w = widths[y]
        x[i & 1] = base[y] + (ahead[p] >> (log - w))
        p += w
    return bytes(out)


def lzw_compress(data: bytes) -> bytes:
    """Codes of 4 bytes, little-endian; the dictionary begins with all single bytes and has no bound."""
    if not data:
        return b""
    # by code and the byte that follows: the code of both
    known: dict[int, int] = {}
    get, out, free = known.get, [], 256
    rest = iter(data)
    current = next(rest)
    for b in rest:
        key = current << 8 | b
        found = get(key)
        if found is None:
            out.append(current)
            known[key] = free
            free += 1
            current = b
        else:
            current = found
    out.append(current)
    return np.array(out, "<u4").tobytes()


def lzw_decompress(data: bytes) -> bytes:
    codes = np.frombuffer(data, "<u4").tolist()
    if not codes:
        return b""
    known = [bytes([i]) for i in range(256)]
    last = known[codes[0]]
    out = [last]
    for c in codes[1:]:
        entry = known[c] if c < len(known) else last + last[:1]
        out.append(entry)
        known.append(last + entry[:1])
        last = entry
    return b"".join(out)


def required_bits(most: int) -> int:
    """Width that holds 0 .. most."""
    if most < 0:
        raise ValueError("only numbers from 0 on can be packed")
    return max(1, int(most).bit_length())


def bit_pack(values: np.ndarray, width: int) -> bytes:
    """Numbers from 0 on of 1 to 64 bits each, highest bit first, the last byte filled with zeros."""
    values = np.asarray(values)
    if not 1 <= width <= 64:
        raise ValueError("width is 1 to 64")
    if len(values) and (values.min() < 0 or int(values.max()).bit_length() > width):
        raise ValueError("a number doesn't fit")
    wide = values.astype(np.uint64)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits((wide & np.uint64(1)).astype(np.uint8).reshape(-1)).tobytes()


def bit_unpack(data: bytes, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: n * width].reshape(n, width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out << np.uint64(1) | bits[:, k]
    return out.astype(np.int64) if width < 64 else out


def none(data: bytes) -> bytes:
    return data


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "NONE": (none, none),
    "DELTA": (delta_compress, delta_decompress),
    "RLE": (rle_compress, rle_decompress),
    "LZ77": (lz77_compress, lz77_decompress),
    "HUFFMAN": (huffman_compress, huffman_decompress),
    "FSE": (fse_compress, fse_decompress),
    "LZW": (lzw_compress, lzw_decompress),
}
_ALIASES = {"DE": "DELTA", "RUNLENGTHENCODING": "RLE", "RUN_LENGTH_ENCODING": "RLE", "FINITESTATEENTROPY": "FSE", "FINITE_STATE_ENTROPY": "FSE"}


def codec_name(name: str) -> str:
    """The codec that a name or alias, in any case, stands for."""
    key = name.strip().upper()
    key = _ALIASES.get(key, key)
    if key not in CODECS:
        raise ValueError(f"unknown codec {name!r}; there are {', '.join(CODECS)}")
    return key

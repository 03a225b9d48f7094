"""The codecs' own Python, taken where the JVM can't run them."""

import random
import sys
import tracemalloc

import numpy as np
import pytest

from treeframe.functions.codecs import CODECS, _bits, huffman_compress, huffman_decompress

rng = random.Random(6)
PAGE = bytes(rng.choices(range(256), weights=[1 / (1 + k) for k in range(256)], k=20_000))


def calls(f, *args):
    """What f returns, and the calls of functions meanwhile, those in C too."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = f(*args)
    finally:
        sys.setprofile(None)
    return out, n


def test_huffman_has_no_call_for_each_symbol():
    """F5"""
    packed = huffman_compress(PAGE)
    out, n = calls(huffman_decompress, packed)
    assert out == PAGE and n < len(PAGE) // 4
    for cut in range(4, 8):
        with pytest.raises(IndexError):
            huffman_decompress(packed[:-cut])


@pytest.mark.parametrize("depth", [19, 20, 21, 24])
def test_huffman_of_long_codes(depth):
    """on both sides of the size up to which codes are looked up in a table; counts as Fibonacci's numbers."""
    counts = [1, 1]
    while len(counts) < depth + 1:
        counts.append(counts[-1] + counts[-2])
    data = b"".join(bytes([s]) * n for s, n in enumerate(counts))
    packed = huffman_compress(data)
    assert max(packed[6 : 5 + 2 * len(counts) : 2]) == depth and huffman_decompress(packed) == data


@pytest.mark.parametrize("most", [1, 8, 31, 32, 33, 50])
def test_bits(most):
    """numbers of no bits, too, and those of more than a word of 32."""
    lengths = np.array([most, *(rng.randrange(most + 1) for _ in range(300))], np.int64)
    values = np.array([rng.getrandbits(int(k)) if k else 0 for k in lengths], np.int64)
    text = "".join(f"{v:0{k}b}" for v, k in zip(values.tolist(), lengths.tolist()) if k)
    assert _bits(values, lengths) == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8))
    assert _bits(lengths[:0], lengths[:0]) == b""


def test_lzw_holds_no_texts():
    """the dictionary has a number for each text; of a long run, the texts were as long as the run together."""
    data = b"x" * 400_000
    tracemalloc.start()
    packed = CODECS["LZW"][0](data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(data) // 2 and CODECS["LZW"][1](packed) == data
    for n in (0, 1, 2, 3, 300):
        assert CODECS["LZW"][1](CODECS["LZW"][0](PAGE[:n])) == PAGE[:n]

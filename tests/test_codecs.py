import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeframe.functions import bson
from treeframe.functions.codecs import CODECS, bit_pack, bit_unpack, code_lengths, codec_name, delta_compress, lz77_compress, lz77_decompress, normalised_counts, required_bits, rle_compress, rle_decompress
from treeframe.plans.pipeline import GENERAL, Builder, Pipeline, parse_pipelines

rng = random.Random(4)
SENTENCE = b"The quick brown fox jumps over the lazy dog. A repeated sentence is easy to shrink. " * 5
ALNUM = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(10_000))
ASCII = bytes(rng.randrange(32, 127) for _ in range(10_000))
CASES = [b"", b"x", b"\0", b"x" * 1000, bytes(range(256)), np.arange(400, dtype="<i8").tobytes(), b"y" * 255, b"y" * 256, b"y" * 511, b"a" * 9000 + b"b" * 1000, SENTENCE, ALNUM, ASCII, rng.randbytes(4096) * 2, rng.randbytes(4097) * 2]


@pytest.mark.parametrize("name", CODECS)
def test_round_trip(name):
    compress, decompress = CODECS[name]
    for case in CASES:
        assert decompress(compress(case)) == case


@pytest.mark.parametrize("name", CODECS)
@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=300) | st.lists(st.sampled_from([0, 0, 0, 1, 255]), max_size=400).map(bytes))
def test_round_trip_of_anything(name, data):
    compress, decompress = CODECS[name]
    assert decompress(compress(data)) == data


def test_smaller():
    assert len(lz77_compress(SENTENCE, 128, 32)) < len(SENTENCE)
    assert lz77_decompress(lz77_compress(SENTENCE, 64, 32)) == SENTENCE
    for name in ("HUFFMAN", "FSE"):
        for case in (SENTENCE, ALNUM, ASCII):
            assert len(CODECS[name][0](case)) < len(case)


def test_exact_bytes():
    assert delta_compress(bytes([1, 3, 5, 255, 0])) == bytes([1, 2, 2, 250, 1])
    assert rle_compress(b"a" * 300 + b"b") == bytes([255, 97, 45, 97, 1, 98])
    assert lz77_compress(b"abcabc") == b"\x01a\x01b\x01c\x00\x00\x03\x03"
    # a match may run into itself
    assert lz77_compress(b"aaaaa") == b'\x01a\x00\x00\x01\x04'
    assert lz77_decompress(lz77_compress(b"aaaaa")) == b"aaaaa"
    with pytest.raises(ValueError):
        rle_decompress(b"\x01")
    with pytest.raises(ValueError):
        lz77_decompress(b"\x00\x00\x09\x03")


def test_code_lengths_are_optimal():
    assert code_lengths(np.array([5, 1, 1, 0])).tolist() == [1, 2, 2, 0]
    assert normalised_counts(np.array([90, 9, 1, 0]), 5).sum() == 32


def test_bit_packing():
    assert [required_bits(v) for v in (0, 1, 2, 255, 256)] == [1, 1, 2, 8, 9]
    assert bit_pack(np.array([1, 2, 3]), 2) == bytes([0b01101100])
    for width in (1, 7, 8, 13, 58, 63, 64):
        v = np.array([rng.randrange(1 << width) for _ in range(77)], np.uint64)
        assert (bit_unpack(bit_pack(v, width), width, 77).astype(np.uint64) == v).all()
    with pytest.raises(ValueError):
        bit_pack(np.array([-1]), 8)


def test_pipeline():
    assert codec_name("FiniteStateEntropy") == "FSE" and codec_name(" de ") == "DELTA"
    with pytest.raises(ValueError):
        codec_name("zip")
    for case in CASES:
        assert GENERAL.decompress(GENERAL.compress(case)) == case
    p = Builder().add("delta").add(zlib.compress, zlib.decompress).build()
    assert p.names == ["DELTA", "CUSTOM"] and p.decompress(p.compress(ALNUM)) == ALNUM
    assert Pipeline.of(["RLE", "DELTA"]).decompress(Pipeline.of(["RLE", "DELTA"]).compress(ASCII), ["DELTA", "RLE"]) == ASCII
    data, taken = Pipeline.of(["RLE", "HUFFMAN"], skip_if_larger=True).compress_page(ALNUM)
    assert taken == ["HUFFMAN"] and Pipeline.of(taken).decompress(data) == ALNUM
    assert parse_pipelines('{"a": ["lz77", "fse"]}')["a"].names == ["LZ77", "FSE"]
    for body in ("[1]", "{", '{"a": "lz77"}', '{"a": ["what"]}'):
        with pytest.raises(ValueError):
            parse_pipelines(body)


def test_bson():
    tree = {"b": [1, 2.5, "x", None, True], "a": {"n": 1 << 40, "s": "é"}}
    raw = bson.encode(tree)
    assert bson.decode(raw) == {"a": {"n": 1 << 40, "s": "é"}, "b": [1, 2.5, "x", None, True]}
    assert bson.encode({"a": 1}) == b"\x0c\x00\x00\x00\x10a\x00\x01\x00\x00\x00\x00"

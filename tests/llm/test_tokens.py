import base64
import os
import random

import numpy as np
import pytest

from treeframe.llm import bpe
from treeframe.llm import token_store as ts

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files here")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read()


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    signs = "ab'sStrevdlm  \n\t ́é1²٣!?　𝒳漢-\r \x85"
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return [*out, "", "'s", "x's 'll", "''s", "\n's", "it's 'RE 've'd", " " * 50, "a" * 5000, "ab" * 3000, "<|endoftext|>", "🙂" * 40, "\0\0", "the cat " * 400]


def test_equals_the_reference(vocabulary, reference):
    t = texts()
    raw = [x.encode() for x in t]
    encoder = bpe.Encoder(vocabulary)
    ids, bound, same = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for i, x in enumerate(t):
        assert ids[bound[i] : bound[i + 1]].tolist() == reference.encode_ordinary(x), x
    assert vocabulary.decode(ids).tobytes() == b"".join(raw) and same.all()


def test_each_text_is_held_against_its_own_ids(vocabulary):
    """Also where the ids of all give the bytes of all."""
    data, offsets = np.frombuffer(b"abab", np.uint8), np.array([0, 1, 2, 4])
    a, b = vocabulary.ranks[b"a"], vocabulary.ranks[b"b"]
    ids = np.array([a, b, a, b], np.int32)
    assert vocabulary.decodes(ids, np.array([0, 1, 2, 4]), data, offsets).all()
    assert vocabulary.decodes(ids, np.array([0, 2, 2, 4]), data, offsets).tolist() == [False, False, True]
    assert vocabulary.decodes(ids[::-1], np.array([0, 1, 2, 4]), data, offsets).tolist() == [False, False, False]


def test_pretokens_equal_the_pattern():
    import regex

    for x in texts():
        raw = x.encode()
        start, _ = bpe.pretokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        cuts = [*start.tolist(), len(raw)]
        assert [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])] == regex.findall(PATTERN, x)


def test_heap_equals_repeated_merging(vocabulary):
    rng = random.Random(5)
    for _ in range(300):
        word = bytes(rng.choice(b"etaoinshr th") for _ in range(rng.randrange(1, 30)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranks = [vocabulary.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 30:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert vocabulary.merged(word) == [vocabulary.ranks[p] for p in parts]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    assert bpe.PerfectHash(keys)(keys).tolist() == list(range(n))


def test_perfect_hash_wants_distinct_keys():
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_collisions_are_noticed(vocabulary, reference, monkeypatch):
    """With hashes of 3 bits, ids of other words come out, and decoding shows it."""
    real = bpe.tx.Rolling.__call__
    encoder = bpe.Encoder(vocabulary)
    monkeypatch.setattr(bpe.tx.Rolling, "__call__", lambda self, a, b: real(self, a, b) & np.uint64(7))
    x = "one two three four five six seven eight nine ten eleven twelve"
    ids, *_ = encoder.encode(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))
    assert ids.tolist() == reference.encode_ordinary(x)


def test_memory_is_bounded(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 50)
    encoder = bpe.Encoder(vocabulary)
    for k in range(20):
        x = " ".join(f"word{k}q{i}" for i in range(30))
        ids, *_ = encoder.encode(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))
        assert ids.tolist() == reference.encode_ordinary(x)
        assert encoder.known.n <= 100


def test_frames(spark, docs, empty, clashing, corpus, reference):
    got = bpe.bpe_encode(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.text is None:
            assert (r.token_ids, r.n_tokens, r.decodes) == (None, None, None)
        else:
            assert r.token_ids == reference.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.decodes
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    key = lambda rows: sorted((repr(r[0]), repr(r[1])) for r in rows)
    assert key(back) == key(corpus)
    assert bpe.bpe_encode(empty).count() == 0
    assert bpe.bpe_encode(clashing, clashing.columns).count() == len(corpus)
    named = docs.withColumnRenamed("lang", "Token_IDs").withColumnRenamed("source", "decodes")
    again = bpe.bpe_encode(named, named.columns)
    assert again.columns == ["doc_id", "text", "n_chars", "token_ids", "n_tokens", "decodes"]
    assert again.where("decodes or text is null").count() == len(corpus)
    cut = spark.createDataFrame([(1, [255, 0])], "doc_id long, token_ids array<int>")
    assert bpe.bpe_decode(cut).first().text is not None


def test_vocabulary_file(tmp_path):
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    assert bpe.Vocabulary.read(str(tmp_path / "v")).merged(b"ab") == [97, 98]
    (tmp_path / "w").write_text(f"{base64.b64encode(b'a').decode()} 0")
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(tmp_path / "w"))


def test_numbers_of_keys():
    """Against a dictionary, with keys that want the same places, also beyond the room there is."""
    rng = np.random.default_rng(4)
    own, want = bpe.Numbers(8), {}
    for n in (3, 1, 50, 700, 0, 4000):
        keys = np.unique(np.r_[rng.integers(0, 1 << 63, n).astype(np.uint64), np.arange(n, dtype=np.uint64) << np.uint64(32)])
        found = own(keys)
        assert found.tolist() == [want.get(k, -1) for k in keys.tolist()]
        fresh = keys[found < 0]
        own.add(fresh)
        want |= {k: len(want) + i for i, k in enumerate(fresh.tolist())}
        assert own(keys).tolist() == [want[k] for k in keys.tolist()] and own.n == len(want)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(1000)), [0, 1 << 30], np.cumsum(np.random.default_rng(1).integers(0, 5000, 3000)).tolist(), np.cumsum(np.random.default_rng(2).integers(0, 2, 3000)).tolist()])
def test_elias_fano(values):
    ef = ts.EliasFano.encode(np.array(values, np.int64))
    assert ef.decode().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), max(1, len(values) // 700))] == values[:: max(1, len(values) // 700)]
    for bad in (-1, len(values)):
        with pytest.raises(IndexError):
            ef.select(bad)
    if len(values) >= 1000:
        ideal = max(1, np.log2(max(values[-1] / len(values), 1)))
        assert ef.bits / len(values) < ideal + 2.5
    with pytest.raises(ValueError):
        ts.EliasFano.encode(np.array([2, 1]))


@pytest.mark.parametrize("block", [1, 100, 5000, 1 << 22])
def test_blocks_round_trip(docs, empty, clashing, corpus, block):
    blocks = ts.token_blocks(docs, "text", 256, block)
    got = sorted((repr(r.doc_id), bytes(r.token_ids)) for r in ts.read_blocks(blocks).collect())
    assert got == sorted((repr(r[0]), (r[1] or "").encode()) for r in corpus)
    rows = blocks.collect()
    assert len({r.block for r in rows}) == len(rows)
    for r in rows:
        assert r.n_docs == len(r.doc_ids) and r.n_ids * r.id_bytes == len(r.ids)
        assert r.n_ids <= block or sum(len(ts.document(r, i)) > 0 for i in range(r.n_docs)) == 1
    one = rows[0]
    again = {repr(d): ts.document(one, i).tobytes() for i, d in enumerate(one.doc_ids)}
    assert set(again.items()) <= {(repr(r[0]), (r[1] or "").encode()) for r in corpus}
    assert ts.token_blocks(empty, "text", 256).count() == 0
    assert ts.token_blocks(clashing, "text", 256).count() == ts.token_blocks(docs, "text", 256).count()
    assert ts.size_report(blocks).count() == len(rows)


def test_blocks_of_tokens(spark, docs, corpus, tmp_path):
    tokens = bpe.bpe_encode(docs)
    ts.write_token_files(tokens, f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.first().id_bytes == 2
    want = sorted((repr(r.doc_id), r.token_ids or []) for r in tokens.collect())
    assert sorted((repr(r.doc_id), r.token_ids) for r in ts.read_blocks(stored).collect()) == want
    # the registered way, in one pass
    direct = ts.bpe_token_blocks(docs)
    assert sorted((repr(r.doc_id), r.token_ids) for r in ts.read_blocks(direct).collect()) == want
    assert direct.schema == ts.token_blocks(tokens).schema and direct.first().id_bytes == 2
    small = ts.bpe_token_blocks(docs, block_ids=500)
    assert sorted((repr(r.doc_id), r.token_ids) for r in ts.read_blocks(small).collect()) == want and small.count() > 5
    # every document by select, against slices of the whole
    for blocks in (direct, small):
        got = ts.fetch(blocks, docs.selectExpr("doc_id", "1 AS tf_id")).collect()
        assert sorted((repr(r.doc_id), r.token_ids) for r in got) == want
        whole = {r.block: np.frombuffer(r.ids, "<u2") for r in blocks.collect()}
        assert all(whole[r.block][r.offset : r.offset + len(r.token_ids)].tolist() == r.token_ids for r in got)
    assert sorted(repr(r.doc_id) for r in ts.fetch(small, spark.createDataFrame([(3,), (5,), (None,), (10**6,)], "doc_id long")).collect()) == sorted(repr(r[0]) for r in corpus if r[0] in (3, 5, None))
    assert ts.bpe_token_blocks(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside"):
        ts.token_blocks(tokens, vocabulary_size=100).collect()
    assert [ts.id_type(n).itemsize for n in (256, 257, 65536, 65537)] == [1, 2, 2, 4]

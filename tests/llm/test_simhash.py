import numpy as np
import pyarrow as pa

from treeframe.llm import simhash as sh
from treeframe.llm.graph import components


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def test_fingerprint_of_one_by_hand():
    data, offsets = packed(["One two, THREE", "one Two three!", "", "x", "one two three four five six seven"])
    f = sh.fingerprints(data, offsets)
    assert (f[0] == f[1]).all() and (f[0] != f[2]).any() and f.shape == (5, 32)
    assert (sh.fingerprints(*packed(["a"]))[0] == sh.fingerprints(*packed(["zzz zz", "a"]))[1]).all()


def test_against_brute_force(docs, corpus):
    """Recall of 0.9 at least against all pairs, and no pair that they don't give."""
    own = sorted({(r[0], r[1]) for r in corpus if r[1] is not None}, key=repr)
    sigs = sh.fingerprints(*packed([t for _, t in own])).view(np.uint64)
    far = np.array([[int(np.bitwise_count(a ^ b).sum()) for b in sigs] for a in sigs])
    a, b = np.nonzero(far <= sh.DISTANCE)
    root = sh.local_roots(len(own), a, b)
    first = {r: min((i for i in range(len(own)) if root[i] == r), key=lambda i: (own[i][0] is not None, own[i][0] or 0)) for r in set(root.tolist())}
    near = [far[i, first[root[i]]] <= sh.REACH * sh.DISTANCE for i in range(len(own))]
    want = {frozenset((own[i][0], own[j][0])) for i in range(len(own)) for j in range(i) if root[i] == root[j] and near[i] and near[j]}
    groups = {}
    for r in sh.near_duplicates(docs).collect():
        groups.setdefault((r.kept_doc_id, r.kept_rh), {r.kept_doc_id}).add(r.doc_id)
    got = {frozenset((x, y)) for g in groups.values() for x in g for y in g if x != y}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert {frozenset((i, i - 66)) for i in range(66, 72)} <= got and frozenset((3, 73)) in got


def test_one_of_each_group_stays(docs, empty, clashing, corpus):
    left = sh.without_near_duplicates(docs).collect()
    texts = [r.text for r in left if r.text is not None]
    assert len(texts) == len(set(texts)) and sum(t == "" for t in texts) == 1
    assert sum(r.text is None for r in left) == sum(r[1] is None for r in corpus)
    gone = {(r.doc_id, r.kept_doc_id) for r in sh.simhash_dedup(docs).collect()}
    assert {(72, 3), (73, 3), (75, 74), (5, 5)} <= gone
    alone = {i for i in range(6, 60)}
    assert alone <= {r.doc_id for r in left}
    assert sh.without_near_duplicates(empty).count() == 0 and sh.simhash_dedup(empty).count() == 0
    wide = sh.without_near_duplicates(clashing)
    assert wide.columns == clashing.columns and wide.count() == len(left)


def test_chains_are_cut(spark, monkeypatch):
    """Of a chain of texts, each near the next, those far from the one that stays aren't taken for its copies; their own are found."""
    bits = np.zeros((4, 256), bool)
    for i in range(1, 4):
        bits[i] = bits[i - 1]
        bits[i, 40 * i : 40 * i + 40] = True
    chain = np.packbits(bits, axis=1)
    monkeypatch.setattr(sh, "fingerprints", lambda data, offsets, shingle=2: chain[[int(bytes(data[a:b]).decode()[0]) for a, b in zip(offsets[:-1], offsets[1:])]])
    monkeypatch.setattr(sh, "_fingerprinted", lambda shingle: lambda batches: (pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rh"), sh._fixed(chain[[int(t[0]) for t in b.column("text").to_pylist()]])], ["doc_id", "rh", "sig"]) for b in batches))
    df = spark.createDataFrame([(10, "0"), (11, "1"), (12, "2"), (13, "3"), (14, "3 again"), (15, "3 again")], "doc_id long, text string")
    got = {(r.doc_id, r.kept_doc_id) for r in sh.simhash_dedup(df, distance=48).collect()}
    assert got == {(11, 10), (14, 13), (15, 13)}


def test_the_survivor_is_the_same_one(spark):
    """Of rows with one doc_id and text, however they are spread."""
    rows = [(1, "one and the same text here", f"s{i}") for i in range(8)]
    kept = {tuple(r) for n in (1, 3, 8) for r in sh.without_near_duplicates(spark.createDataFrame(rows[n % 5 :] + rows[: n % 5], "doc_id long, text string, source string").repartition(n)).collect()}
    assert len(kept) == 1


def test_large_buckets_are_split_and_searched():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (300, 32), dtype=np.uint8)
    near = base.copy()
    near[:, 5] ^= 1
    sigs = np.concatenate([base, near])
    key = sh.sampled(sigs, sh.samples(1)[0])
    pairs = set()
    for t in range(24):
        a, b = sh.close_pairs(sigs, sh.sampled(sigs, sh.samples(24)[t]), 0, 16, 64)
        pairs |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    assert pairs == {(i, i + 300) for i in range(300)}
    # all the same in the sampled coordinates: no splitting helps, all pairs are verified
    same = np.repeat(base[:1], 100, axis=0)
    a, _ = sh.close_pairs(same, np.zeros(100, np.uint64), 0, 16, 64)
    assert len(a) == 100 * 99 // 2 and len(key) == 600


def test_recall_does_not_fall_with_the_number_of_fingerprints(spark):
    """Pairs at the full distance among many others, with a cap that acts."""
    for distance in (sh.DISTANCE, 64):
        for n in (10**3, 10**5, 10**7, 10**9, 10**11):
            _, bits, tables = sh.layout(n, sh.TABLES, distance, sh.CAP)
            assert 1 - (1 - sh.chance(bits, distance)) ** tables >= 0.9 and n / 2**bits <= sh.CAP
    rng = np.random.default_rng(3)
    n, cap = 6000, 8
    base = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    flip = np.zeros((300, 256), bool)
    for row in flip:
        row[rng.choice(256, 64, replace=False)] = True
    sigs = np.concatenate([base, base[:300] ^ np.packbits(flip, axis=1)])
    group, bits, tables = sh.layout(len(sigs), sh.TABLES, 64, cap)
    assert bits == 10 and tables > sh.TABLES
    found = set()
    for t in range(tables):
        one = pa.table([pa.array([t] * len(sigs)), sh._fixed(sigs)], names=["t", "sig"])
        out = sh._verified(tables, bits, cap, 64)(one)
        found |= {frozenset(p) for p in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    want = [frozenset((sigs[i].tobytes(), sigs[n + i].tobytes())) for i in range(300)]
    assert sum(w in found for w in want) >= 0.85 * len(want)


def test_buckets_over_the_cap_are_searched_whole():
    """A dense bucket: splitting it parts pairs that are within the distance."""
    rng = np.random.default_rng(4)
    sigs = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    flip = np.zeros((100, 256), bool)
    for row in flip:
        row[rng.choice(256, 64, replace=False)] = True
    sigs[100:] = sigs[:100] ^ np.packbits(flip, axis=1)
    key = sh.sampled(sigs, sh.samples(1)[0])
    a, b = sh.close_pairs(sigs, key, 0, 16, 64)
    root = sh.local_roots(len(sigs), a, b)
    c, d = sh.rest_of_large(sigs, key, 0, 16, 64, root)
    pairs = {(i, i + 100) for i in range(100)}
    assert not pairs <= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    assert pairs <= {tuple(sorted(p)) for p in zip([*a.tolist(), *c.tolist()], [*b.tolist(), *d.tolist()])}
    out = sh._verified(1, 0, 16, 64)(pa.table([pa.array([0] * 200), sh._fixed(sigs)], names=["t", "sig"]))
    assert len(out) == 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

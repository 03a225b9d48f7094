import hashlib
from collections import Counter
from math import floor, sqrt

import pytest

from treeframe.llm import mixing


def brute(rows, weights=None, total=None, seed=mixing.SEED):
    """Quota, whole copies and ranking of every source, sorted as a whole."""
    own = [(i, s, n.bit_length() if n and n > 0 else 0) for i, _, _, s, n in rows]
    own = [r for r in own if r[2]]
    size = Counter(s for _, s, _ in own)
    w = {s: floor(sqrt(n) * 1e6) if weights is None else int(round(weights.get(s, 0) * 1e6)) for s, n in size.items()}
    w = {s: x for s, x in w.items() if x}
    all_w, n = sum(w.values()), sum(size[s] for s in w) if total is None else total
    quota = {s: n * x // all_w for s, x in w.items()}
    rest = sorted(w, key=lambda s: (-(n * w[s] % all_w), s is not None, s))
    for s in rest[: n - sum(quota.values())]:
        quota[s] += 1
    out = []
    for s in w:
        mine = [(i, x) for i, t, x in own if t == s]
        total_x = sum(x for _, x in mine)
        ranked, copies = [], []
        for k, (i, x) in enumerate(mine):
            copies.append(quota[s] * x // total_x)
            f = quota[s] * x % total_x / total_x
            u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if f:
                ranked.append(((u / (1 - u)) * ((1 - f) / f), i is not None, i or 0, k))
        for *_, k in sorted(ranked)[: quota[s] - sum(copies)]:
            copies[k] += 1
        assert sum(copies) == quota[s]
        out += [(i, s, c) for (i, _), c in zip(mine, copies) if c]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bins", [1, 7, 4096])
@pytest.mark.parametrize("weights,total", [(None, None), ({"s0": 3, "s1": 1, None: 1, "zz": 5}, 200), ({"s2": 1}, 7), ({"s3": 0.5, "s9": 0.5}, 1000)])
def test_against_brute_force(docs, corpus, monkeypatch, bins, weights, total):
    monkeypatch.setattr(mixing, "BINS", bins)
    got = sorted(((r.doc_id, r.source, r.copies) for r in mixing.copies(docs, weights, total).collect()), key=repr)
    assert got == brute(corpus, weights, total)


def test_mixture(docs, corpus, empty, clashing):
    rows = mixing.mixed(docs, total=500).collect()
    assert len(rows) == 500 and mixing.mixed(docs).columns == docs.columns
    want = Counter()
    for i, s, c in brute(corpus, total=500):
        want[(i, s)] += c
    assert Counter((r.doc_id, r.source) for r in rows) == want
    assert mixing.copies(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(clashing).count() == mixing.mixed(docs).count()
    named = mixing.copies(docs.withColumnRenamed("lang", "Copies"))
    assert named.columns == ["doc_id", "text", "source", "n_chars", "copies"] and named.count() == mixing.copies(docs).count()
    # a tiny weight is none, but not lost; only relations count
    shares = [{"s0": 1.0, "s1": 1e-9, "s2": 0.0}, {"s0": 1e12, "s1": 1e3, "s2": 0}]
    a, b = (sorted((repr(r.doc_id), r.copies) for r in mixing.copies(docs, w, 10**11).collect()) for w in shares)
    assert a == b and 0 < mixing.copies(docs, shares[0], 10**11).where("source = 's1'").count()
    assert mixing.copies(docs, {"s0": 0.0}).count() == 0
    for bad in ({}, {"s0": -1}, {"s0": float("nan")}, {"s0": float("inf")}):
        with pytest.raises(ValueError):
            mixing.copies(docs, bad)


def test_inclusion_follows_the_measure(spark):
    """Over many sources a document is sampled as often as its share says."""
    df = spark.createDataFrame([(i, f"s{i // 40}", 1 if i % 40 < 20 else 255) for i in range(1600)], "doc_id long, source string, n_chars long")
    seen = Counter(r.n_chars for r in mixing.copies(df, total=400).collect())
    # in each 10 of 20 documents of measure 1 and 20 of 8
    assert seen[1] + seen[255] == 400 and 25 <= seen[1] <= 66


def test_few_sources_or_many(docs, monkeypatch):
    few = sorted(map(repr, mixing.copies(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.copies(docs).collect())) == few

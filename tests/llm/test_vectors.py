import numpy as np
import pytest

from pyspark.sql import functions as F

from treeframe.llm.ann import grow, nearest_neighbours, packed
from treeframe.llm.exact_topk import exact_topk
from treeframe.llm.vectors import clean

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, n=400, dim=12, seed=0, spread=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if spread:
        x *= rng.lognormal(0, 1, (n, 1)).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(n, None, 1), (n + 1, [], 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 1), (n + 3, [None] + [0.0] * (dim - 1), 1), (None, [0.5] * dim, 1), (n + 4, [0.0] * dim, 1), (n + 5, [1.0, 2.0], 1), rows[9]]
    kept = [*rows, (None, [0.5] * dim, 1), (n + 4, [0.0] * dim, 1), (n + 5, [1.0, 2.0] + [0.0] * (dim - 2), 1)]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3), kept


def brute(kept, k, score):
    x = np.array([v for _, v, _ in kept], np.float32).astype(float)
    ids = [i for i, *_ in kept]
    out = {}
    for i in range(len(kept)):
        s = score(x[i], x)
        order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-round(float(s[j]), 9), ids[j] is not None, ids[j] or 0))
        out[ids[i]] = [(ids[j], round(float(s[j]), 6)) for j in order[:k]]
    return out


@pytest.mark.parametrize("block,group,asked,head", [(64, 2, 50, 4), (64, 1, 1000, 12), (1000, 8, 100, 3), (7, 3, 20, 1)])
def test_exact(spark, block, group, asked, head):
    """Several rounds, and blocks and groups of one."""
    df, kept = table(spark, 150 if block == 7 else 400)
    got = {}
    for r in exact_topk(df, 5, block=block, group=group, query_block=asked, head=head).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.match_id, round(r.score, 6)))
    want = brute(kept, 5, lambda q, x: (q * x).sum(1))
    assert {k: [s for _, s in v] for k, v in got.items()} == {k: [s for _, s in v] for k, v in want.items()}
    assert sum(got[k] == want[k] for k in want) >= len(want) - 1


def test_exact_asks_some(spark):
    df, kept = table(spark)
    got = exact_topk(df, 5, queries=F.col("vec_id") % 20 == 0, block=32, group=2).collect()
    want = brute(kept, 5, lambda q, x: (q * x).sum(1))
    assert {r.vec_id for r in got} == {k for k in want if k is not None and k % 20 == 0}
    assert sorted((r.vec_id, r["rank"], round(r.score, 6)) for r in got) == sorted((k, i + 1, s) for k, v in want.items() if k is not None and k % 20 == 0 for i, (_, s) in enumerate(v))
    assert exact_topk(df, 5, queries=F.lit(False)).count() == 0


def test_exact_many_equal(spark):
    """Equal vectors are told apart by their keys, k for each query; nothing is lost where all lengths tie."""
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(90)], SCHEMA)
    got = exact_topk(same, 3, block=16, group=2, query_block=40).collect()
    assert {(r.vec_id, r["rank"]): r.match_id for r in got} == {(i, n + 1): m for i in range(90) for n, m in enumerate([m for m in range(4) if m != i][:3])}


def test_exact_edges(spark):
    assert exact_topk(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)
    assert exact_topk(one).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA).selectExpr("*", "'x' AS block", "1 AS score", "2 AS ids")
    assert sorted(map(tuple, exact_topk(two).collect())) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]


def test_clean(spark):
    df, kept = table(spark)
    v, dim = clean(df)
    assert dim == 12 and v.count() == len(kept)


@pytest.mark.parametrize("leaf", [25, 2000])
def test_ann_recall(spark, leaf):
    df, kept = table(spark, 1200, spread=False)
    want = brute(kept, 10, lambda q, x: -np.sqrt(((q - x) ** 2).sum(1)))
    got = {}
    for r in nearest_neighbours(df, leaf=leaf, branches=6).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, -round(r.distance, 6)))
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())


def test_ann_of_a_sample(spark):
    """Fitted on some of the vectors, with leaves of several shards and queries that are a part."""
    df, kept = table(spark, 1500, spread=False)
    want = brute(kept, 10, lambda q, x: -np.sqrt(((q - x) ** 2).sum(1)))
    got = {}
    for r in nearest_neighbours(df, leaf=100, branches=4, sample=400, most=60, queries=F.col("vec_id") % 3 == 0).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert set(got) == {k for k in want if k is not None and k % 3 == 0}
    hits = sum(len(set(v) & {i for i, _ in want[k]}) for k, v in got.items())
    assert hits >= 0.9 * 10 * len(got) and all(len(v) == 10 for v in got.values())


def test_ann_edges(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)
    assert nearest_neighbours(one).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(60)], SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS h", "2 AS bin", "3 AS shard")
    got = nearest_neighbours(same, k=3, leaf=10, branches=4, most=16).collect()
    assert {(r.vec_id, r["rank"]): r.neighbour_id for r in got} == {(i, n + 1): m for i in range(60) for n, m in enumerate([m for m in range(4) if m != i][:3])}


def test_tree():
    """Visits come to every leaf, the own first; equal rows can't be split."""
    x = np.random.default_rng(1).normal(size=(500, 6))
    tree = grow(x, 4, 20)
    assert tree.leaves > 20 and sorted(tree.visits(x[:1], 10**6)[0]) == list(range(tree.leaves))
    assert [v[0] for v in tree.visits(x[:50], 3)] == tree.descend(x[:50]).tolist()
    assert np.bincount(tree.descend(x)).max() <= 20
    one = grow(np.ones((70, 3)), 4, 20)
    assert one.leaves == 1 and one.visits(np.ones((2, 3)), 5) == [[0], [0]]


def test_packed():
    bins, shards = packed(np.array([3, 4, 2, 30, 0, 5]), 8)
    assert bins.tolist() == [0, 0, 1, 2, 3, 3]
    assert shards.tolist() == [1, 1, 4, 1]

"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample, from the root: the vectors of a node are split by k-means until a
leaf has few. Every vector of the table is then sent to its leaf. A query visits leaves best bin first: a
priority queue holds the branches met on the way, by the distance of their centre; each visit takes the
nearest and goes down to a leaf. How many leaves that must be is calibrated: for some of the vectors the
exact neighbours are found, and visits are widened until the wanted share of these lies in visited leaves.

Leaves that are side by side in the tree share a bin, which is one task; a leaf with more vectors than a
bin may have is cut into shards. A query's vector goes once to each bin of which it visits leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm.exact_topk import _first
from treeframe.llm.store import written
from treeframe.llm.vectors import best, clean, dots, matrix, some

#: neighbours; branches of a node; vectors that a leaf should have; rounds of k-means
K, BRANCHES, LEAF, ROUNDS = 10, 16, 64, 5
#: most vectors that the tree is fitted on: a bound on the driver's work, whatever the table; and the
#: fewest of them in a leaf, so that there are at most SAMPLE / LEAST leaves
SAMPLE, LEAST = 1 << 17, 32
#: share of true neighbours that calibration must find, and queries that it uses
RECALL, PROBES = 0.93, 256
#: vectors of a bin
BIN = 8192
_STEP = 256


class Tree:
    """Node 0 is the root; the children of a node are numbered one after the other."""

    def __init__(self, dim: int):
        self.centres = np.zeros((1, dim))
        self.first, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def finish(self) -> Tree:
        """Numbers the leaves from left to right."""
        self.leaf = np.full(len(self.count), -1, np.int64)
        stack, n = [0], 0
        while stack:
            node = stack.pop()
            if self.count[node]:
                stack += range(int(self.first[node] + self.count[node]) - 1, int(self.first[node]) - 1, -1)
            else:
                self.leaf[node] = n
                n += 1
        self.leaves = n
        self.half = (self.centres**2).sum(1) / 2
        return self

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going to the nearest centre at each level."""
        node = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(self.count[node] > 0)
        while len(inner):
            order = inner[np.argsort(node[inner], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0, True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows, here = order[a:b], node[order[a]]
                own = slice(int(self.first[here]), int(self.first[here] + self.count[here]))
                node[rows] = own.start + (x[rows] @ self.centres[own].T - self.half[own]).argmax(1)
            inner = inner[self.count[node[inner]] > 0]
        return self.leaf[node]

    def visits(self, x: np.ndarray, n: int) -> list[list[int]]:
        """The first n leaves of each query, best bin first."""
        first, count, leaf = self.first.tolist(), self.count.tolist(), self.leaf.tolist()
        out = []
        for a in range(0, len(x), _STEP):
            for far in (self.half - x[a : a + _STEP] @ self.centres.T).tolist():
                queue, own = [(0.0, 0)], []
                while queue and len(own) < n:
                    _, node = heapq.heappop(queue)
                    while count[node]:
                        children = range(first[node], first[node] + count[node])
                        nearest = min(children, key=far.__getitem__)
                        for j in children:
                            if j != nearest:
                                heapq.heappush(queue, (far[j], j))
                        node = nearest
                    own.append(leaf[node])
                out.append(own)
        return out


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, centre of each row), from distinct rows spread over x; a centre that loses all its rows goes."""
    rows = np.unique(x[:: max(1, len(x) // (4 * k))], axis=0)
    centres = rows[:: max(1, len(rows) // k)][:k]
    for i in range(rounds + 1):
        own = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        there, own = np.unique(own, return_inverse=True)
        if i == rounds:
            return centres[there], own
        seen = (own[None, :] == np.arange(len(there))[:, None]).astype(float)
        centres = seen @ x / seen.sum(1, keepdims=True)
    raise AssertionError


def grow(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = ROUNDS) -> Tree:
    """The tree of the rows, with leaves of up to about `leaf` of them; rows that are all equal are one leaf."""
    tree = Tree(x.shape[1])
    centres, first, count = [tree.centres], [0], [0]
    todo, n = [(0, np.arange(len(x)))], 1
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        own_centres, own = kmeans(x[rows], min(branches, max(2, -(-len(rows) // leaf))), rounds)
        if len(own_centres) < 2:
            continue
        first[node], count[node] = n, len(own_centres)
        centres.append(own_centres)
        first += [0] * len(own_centres)
        count += [0] * len(own_centres)
        todo += [(n + j, rows[own == j]) for j in range(len(own_centres))]
        n += len(own_centres)
    tree.centres, tree.first, tree.count = np.concatenate(centres), np.array(first), np.array(count)
    return tree.finish()


def fitted(v: DataFrame, dim: int, n: int, branches: int = BRANCHES, leaf: int = LEAF, sample: int = SAMPLE, least: int = LEAST) -> Tree:
    """The tree over the vectors of least hash, at most `sample` of them; in a larger table leaves are larger."""
    rows = v.select("embedding") if n <= sample else v.select(F.xxhash64("embedding", "vec_id", F.lit(1)).alias("h"), "embedding").orderBy("h").limit(sample)
    found = rows.select(F.transform("embedding", lambda e: e.cast("float")).alias("embedding")).toArrow().column("embedding").combine_chunks()
    x = matrix(found, dim)
    # in one order, whatever the partitions
    x = x[np.lexsort(x.T)]
    share = min(1.0, len(x) / n)
    return grow(x[np.random.default_rng(5).permutation(len(x))], branches, max(1, round(leaf * share)) if n <= sample else max(least, round(leaf * share)))


def _leaves(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = sent.value.descend(matrix(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c) for c in ("vec_id", "h", "embedding"))], ["leaf", "vec_id", "h", "embedding"])

    return run


def packed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each leaf, shards of each bin): leaves side by side share a bin of up to `most` vectors."""
    bins, shards, held = np.zeros(len(sizes), np.int64), [1], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            shards.append(1)
            held = 0
        bins[i] = len(shards) - 1
        held += n
        shards[-1] = max(1, -(-held // most))
    return bins, np.array(shards)


def _asked(sent, dim: int, visits: int, bins: np.ndarray, shards: np.ndarray):
    """A row for each query and shard of a bin in which it visits leaves, with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            for a in range(0, len(x), _STEP):
                lists = sent.value.visits(x[a : a + _STEP], visits)
                leaf = np.array([y for z in lists for y in z], np.int64)
                row = np.repeat(np.arange(a, a + len(lists)), [len(y) for y in lists])
                order = np.lexsort((leaf, row))
                leaf, row, own = leaf[order], row[order], bins[leaf[order]]
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (own[1:] != own[:-1])]) if len(row) else row
                times = shards[own[cut]]
                shard = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                which = pa.array(np.repeat(np.arange(len(cut)), times))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(row)].astype(np.int32)), pa.array(leaf)).take(which)
                at = pa.array(np.repeat(row[cut], times))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[cut], times)), pa.array(shard), lists, *(batch.column(c).take(at) for c in ("vec_id", "h", "embedding"))], ["bin", "shard", "leaves", "vec_id", "h", "embedding"])

    return run


def _best_of_bin(dim: int, k: int, key: pa.DataType):
    """Of a bin, for each query the k nearest in the leaves that it visits, itself left out."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["vec_id", "h", "neighbour_id", "distance"]
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (key, pa.int64(), key, pa.float64())], names=names)
        one = lambda t, c: t.column(c).combine_chunks()
        mq, mx = matrix(one(q, "embedding"), dim), matrix(one(x, "embedding"), dim)
        hq, hx = q.column("h").to_numpy(), x.column("h").to_numpy()
        half = (mx * mx).sum(1) / 2
        lists = one(q, "leaves")
        ask_row = np.repeat(np.arange(len(mq)), np.diff(np.asarray(lists.offsets)))
        ask_leaf = np.asarray(lists.flatten())
        by = np.argsort(ask_leaf, kind="stable")
        ask_row, ask_leaf = ask_row[by], ask_leaf[by]
        order = np.argsort(x.column("leaf").to_numpy(), kind="stable")
        leaf = x.column("leaf").to_numpy()[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0, True])
        top = np.full((len(mq), k), -np.inf)
        fa, fb, fs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = np.searchsorted(ask_leaf, leaf[a], "left"), np.searchsorted(ask_leaf, leaf[a], "right")
            cols = order[a:b]
            for i in range(low, high, max(1, (1 << 20) // len(cols))):
                rows = ask_row[i : min(high, i + max(1, (1 << 20) // len(cols)))]
                s = mq[rows] @ mx[cols].T - half[cols]
                s[hq[rows][:, None] == hx[cols][None, :]] = -np.inf
                s[s < top[rows].min(1)[:, None] - 1e-9] = -np.inf
                c, d = best(s, k)
                fa.append(rows[c])
                fb.append(cols[d])
                fs.append(s[c, d])
                both = np.concatenate([top[rows], s], 1)
                top[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
        fa, fb, fs = np.concatenate(fa), np.concatenate(fb), np.concatenate(fs)
        keep = fs >= top[fa].min(1) - 1e-9
        fa, fb = fa[keep], fb[keep]
        far = np.concatenate([np.zeros(0), *(dots(d, d) for d in (mq[fa[i : i + (1 << 16)]] - mx[fb[i : i + (1 << 16)]] for i in range(0, len(fa), 1 << 16)))])
        ids = one(x, "vec_id")
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        kept = _first(fa, -far, rank[fb], k)
        at = pa.array(fa[kept])
        return pa.table([one(q, "vec_id").take(at), one(q, "h").take(at), ids.take(pa.array(fb[kept])), pa.array(np.sqrt(far[kept]))], names=names)

    return run


def calibrated(items: DataFrame, tree: Tree, dim: int, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
    """Leaves that a query must visit for the wanted recall of the k nearest."""
    if tree.leaves == 1:
        return 1
    asked = items.orderBy("h").limit(probes).select("h", "embedding").toArrow()
    x, h = matrix(asked.column("embedding").combine_chunks(), dim), asked.column("h").to_numpy()
    sent = items.sparkSession.sparkContext.broadcast((x, h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, the k nearest of each probe."""
        mq, hq = sent.value
        for batch in batches:
            mx = matrix(batch.column("embedding"), dim)
            s = mq @ mx.T - (mx * mx).sum(1) / 2
            s[hq[:, None] == batch.column("h").to_numpy()[None, :]] = -np.inf
            if s.shape[1] > k:
                cols = np.argpartition(-s, k - 1, axis=1)[:, :k]
            else:
                cols = np.tile(np.arange(s.shape[1]), (len(s), 1))
            rows, cols = np.repeat(np.arange(len(s)), cols.shape[1]), cols.reshape(-1)
            there = s[rows, cols] > -np.inf
            rows, cols = rows[there], cols[there]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), batch.column("leaf").take(pa.array(cols)), pa.array(s[rows, cols])], ["probe", "leaf", "s"])

    found = items.select("h", "embedding", "leaf").mapInArrow(run, "probe int, leaf long, s double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.col("s").desc(), "leaf"))
    true = found.withColumn("k", place).where(F.col("k") <= k).select("probe", "leaf").collect()
    order = [{leaf: i + 1 for i, leaf in enumerate(own)} for own in tree.visits(x, tree.leaves)]
    needed = sorted(order[r.probe][r.leaf] for r in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest_neighbours(
    df: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, recall: float = RECALL, branches: int = BRANCHES, leaf: int = LEAF, sample: int = SAMPLE, most: int = BIN
) -> DataFrame:
    """vec_id, rank, neighbour_id, distance: for every query vector k others near it by Euclidean distance.

    queries: a condition on vec_id; without one, every vector is a query. All vectors are in the index.
    Distances are exact; which vectors are found has the calibrated recall. Ties go to the lower id,
    nulls first. Rows with the same key and vector are one vector, and not its own neighbour; equal
    vectors of several keys are. Null vectors and those with a null or NaN are left out; see
    vectors.clean. Other columns may have any names. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    v, dim = clean(df, key, vector)
    kind = v.schema["vec_id"].dataType.simpleString()
    if not dim:
        return spark.createDataFrame([], f"vec_id {kind}, rank long, neighbour_id {kind}, distance double")
    n = v.count()
    tree = fitted(v, dim, n, branches, leaf, sample)
    sent = spark.sparkContext.broadcast(tree)
    hashed = v.withColumn("h", F.xxhash64("embedding", "vec_id"))
    items = written(hashed.mapInArrow(_leaves(sent, dim), f"leaf long, vec_id {kind}, h long, embedding array<double>"), "leaves")
    visits = calibrated(items, tree, dim, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in items.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r.leaf] = r.n
    bins, shards = packed(sizes, most)
    # one row a leaf
    where = spark.createDataFrame(list(zip(range(len(bins)), bins.tolist(), shards[bins].tolist())), "leaf long, bin long, shards long")
    placed = items.join(F.broadcast(where), "leaf").withColumn("shard", F.pmod(F.xxhash64("h"), "shards")).drop("shards")
    asked = some(hashed, queries).mapInArrow(_asked(sent, dim, visits, bins, shards), f"bin long, shard long, leaves array<long>, vec_id {kind}, h long, embedding array<double>")
    found = asked.groupBy("bin", "shard").cogroup(placed.groupBy("bin", "shard")).applyInArrow(_best_of_bin(dim, k, to_arrow_type(v.schema["vec_id"].dataType)), f"vec_id {kind}, h long, neighbour_id {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("vec_id", "h").orderBy("distance", F.col("neighbour_id").asc_nulls_first()))
    return found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")

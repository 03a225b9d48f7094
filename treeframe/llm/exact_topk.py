"""Exact top-k by inner product, of query vectors against all vectors of a table.

Vectors are sorted by length, longest first, and cut into groups of blocks; queries into blocks of their
own. The search goes in rounds: first every query block meets the group of the longest vectors, then the
next 3, 12, 48 ... groups. A query's floor is its k-th best score so far. A query block meets a group only
if for one of its queries the product of lengths reaches the floor; of blocks in the group, too, only those
are scored. In them, in coordinates rotated by an SVD, the sum over the first ones plus the product of the
residual lengths (Cauchy-Schwarz) tells which vectors can still reach a query's floor; only these are
summed to the end. Floors rise from block to block within a task, and for all tasks after each round.

Where lengths don't differ and no direction outweighs the others, the bounds exclude little, and the work
is the number of queries times that of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm.store import written
from treeframe.llm.vectors import best, binary, clean, dots, matrix, some, unbinary

#: matches of a query; vectors of a block; blocks of a group; queries of a block; coordinates of the first partial sum
K, BLOCK, GROUP, QUERIES, HEAD = 10, 2048, 8, 2048, 16
#: queries that are scored against a block at once
_STEP = 512
#: part of a block left to score at which a full product is cheaper than single ones
_DENSE = 0.02
_SLACK = 1e-9


def rotation(v: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, from the sum of their outer products."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column("embedding"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.reshape(-1))], ["at", "x"])

    rows = v.select("embedding").mapInArrow(partial, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(dim * dim)
    for r in rows:
        gram[r.at] = r.x
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1]


def _blocks(dim: int, block: int, key: pa.DataType):
    """Of a partition, the longest first: a row for each block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        hashes: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def row(ids: pa.Array, h: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt(dots(x, x)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([longest]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([h.tobytes()]), pa.array([binary(x)])], ["grp", "seq", "longest", "ids", "hashes", "x"]
            )

        for batch in batches:
            ids.append(batch.column("vec_id").cast(key))
            hashes.append(batch.column("h").to_numpy())
            rows.append(matrix(batch.column("embedding"), dim))
            while sum(map(len, rows)) >= block:
                all_ids, h, x = pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(rows)
                yield row(all_ids.slice(0, block), h[:block], x[:block])
                seq += 1
                ids, hashes, rows = [pa.concat_arrays([all_ids.slice(block)])], [h[block:]], [x[block:]]
        if sum(map(len, rows)):
            yield row(pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(rows))

    return run


def _by_length(v: DataFrame, rows: int, dim: int, block: int, key: pa.DataType, name: str) -> DataFrame:
    """The table of blocks; partition 0 has the longest vectors."""
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    order = [F.col("length").desc(), F.col("vec_id").asc_nulls_first()]
    wide = v.withColumns({"length": length, "h": F.xxhash64("embedding", "vec_id")})
    cut = wide.repartitionByRange(max(1, -(-v.count() // rows)), *order).sortWithinPartitions(*order)
    kind = v.schema["vec_id"].dataType.simpleString()
    return written(cut.select("vec_id", "h", "embedding").mapInArrow(_blocks(dim, block, key), f"grp long, seq long, longest double, ids array<{kind}>, hashes binary, x binary"), name)


def _floor(column: pa.Array, n: int) -> np.ndarray:
    """Of a row with a list of (qrow, score): the floors of n queries, -inf where none is known."""
    floor = np.full(n, -np.inf)
    if column[0].is_valid:
        known = column[0].values
        score = known.field("score").to_numpy()
        floor[known.field("qrow").to_numpy()] = score - _SLACK * np.maximum(1, np.abs(score))
    return floor


def _open(dim: int, longest: np.ndarray, low: int, high: int):
    """(qblock, grp) for the groups low .. high - 1 whose longest vector may reach the floor of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = unbinary(batch.column("qx")[i].as_py(), dim)
                floor, length = _floor(batch.column("floors").slice(i, 1), len(q)) - _SLACK, np.sqrt(dots(q, q))
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(floor <= 0, -np.inf, floor / length).min()
                grp = low + np.flatnonzero(longest[low:high] >= max(0, least))
                yield pa.RecordBatch.from_arrays([batch.column("qblock").take(pa.array(np.full(len(grp), i))), pa.array(grp)], ["qblock", "grp"])

    return run


def _first(row: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Of candidates, the k of each row with the greatest scores, the lower place first."""
    order = np.lexsort((place, -score, row))
    own = row[order]
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
    return order[rank < k]


def _searched(dim: int, k: int, head: int, turn, key: pa.DataType):
    """A query block against the blocks of a group."""
    head = min(head, dim)

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["qblock", "qrow", "vec_id", "match_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), key, key, pa.float64())], names=names)
        one = lambda t, c: t.column(c).combine_chunks()
        v = turn.value
        qids, qh, qx = one(q, "qids")[0].values, np.frombuffer(q.column("qh")[0].as_py(), np.int64), unbinary(q.column("qx")[0].as_py(), dim)
        floor = _floor(one(q, "floors"), len(qx))
        qr, lq = qx @ v, np.sqrt(dots(qx, qx))
        far_q = np.sqrt(np.maximum(0, (qr[:, head:] ** 2).sum(1)))
        by = np.argsort(one(x, "seq").to_numpy())
        blocks = [unbinary(x.column("x")[int(i)].as_py(), dim) for i in by]
        hashes = [np.frombuffer(x.column("hashes")[int(i)].as_py(), np.int64) for i in by]
        ids = pa.concat_arrays([x.column("ids")[int(i)].values for i in by])
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        fa, fb, fs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        begin = 0
        for xb, xh in zip(blocks, hashes):
            lx = float(np.sqrt(dots(xb, xb)).max())
            todo = np.flatnonzero(lq * lx >= floor - _SLACK)
            if len(todo):
                xr = xb @ v
                far_x = np.sqrt(np.maximum(0, (xr[:, head:] ** 2).sum(1)))
                own_q, own_x = _same(qh, xh, qids, ids.slice(begin, len(xb)), qx, xb)
                new = [_hits(qx[r], qr[r], far_q[r], floor[r], xb, xr, far_x, head, k, _inside(r, own_q, own_x)) for r in (todo[a : a + _STEP] for a in range(0, len(todo), _STEP))]
                fa = np.concatenate([fa, *(todo[a * _STEP + h[0]] for a, h in enumerate(new))])
                fb = np.concatenate([fb, *(h[1] + begin for h in new)])
                fs = np.concatenate([fs, *(h[2] for h in new)])
                kept = _first(fa, fs, rank[fb], k)
                fa, fb, fs = fa[kept], fb[kept], fs[kept]
                full = np.flatnonzero(np.bincount(fa, minlength=len(qx)) == k)
                if len(full):
                    last = fs[np.searchsorted(fa, full, "right") - 1]
                    floor[full] = np.maximum(floor[full], last - _SLACK * np.maximum(1, np.abs(last)))
            begin += len(xb)
        qblock = q.column("qblock")[0].as_py()
        return pa.table([pa.array(np.full(len(fa), qblock, np.int64)), pa.array(fa.astype(np.int32)), qids.take(pa.array(fa)), ids.take(pa.array(fb)), pa.array(fs)], names=names)

    return run


def _same(qh: np.ndarray, xh: np.ndarray, qids: pa.Array, ids: pa.Array, qx: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are one vector: of one key, and equal."""
    order = np.argsort(xh, kind="stable")
    low, high = (np.searchsorted(xh[order], qh, side) for side in ("left", "right"))
    a = np.repeat(np.arange(len(qh)), high - low)
    b = order[np.concatenate([np.arange(i, j) for i, j in zip(low[high > low], high[high > low])])] if len(a) else np.zeros(0, np.int64)
    same = np.array([qids[int(i)].as_py() == ids[int(j)].as_py() for i, j in zip(a, b)], bool) & (qx[a] == x[b]).all(1)
    return a[same], b[same]


def _inside(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of some rows, with the rows counted within them."""
    at = np.minimum(np.searchsorted(rows, a), len(rows) - 1)
    has = rows[at] == a
    return at[has], b[has]


def _hits(q, qr, far_q, floor, x, xr, far_x, head, k, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all that may be among a query's k best of the block, and reach its floor."""
    s = qr[:, :head] @ xr[:, :head].T
    hope = s + np.outer(far_q, far_x) >= (floor - _SLACK)[:, None]
    hope[own] = False
    if hope.mean() > _DENSE:
        s += qr[:, head:] @ xr[:, head:].T
        s[~hope] = -np.inf
        s[s < (floor - _SLACK)[:, None]] = -np.inf
        a, b = best(s, k)
    else:
        a, b = np.nonzero(hope)
    exact = np.concatenate([np.zeros(0), *(dots(q[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]) for i in range(0, len(a), 1 << 16))])
    keep = exact >= floor[a]
    return a[keep], b[keep], exact[keep]


def exact_topk(
    df: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, block: int = BLOCK, group: int = GROUP, query_block: int = QUERIES, head: int = HEAD
) -> DataFrame:
    """vec_id, rank, match_id, score: for every query vector the k others of greatest inner product.

    queries: a condition on vec_id; without one, every vector is a query. All vectors can be matches.
    Ties go to the lower match_id, nulls first. Rows with the same key and vector are one vector; it is
    never its own match, while an equal vector of another key is. Fewer than k others give fewer rows.
    Null vectors and those with a null or NaN are neither queries nor matches; see vectors.clean, also for
    vectors of several lengths. Other columns may have any names. An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    v, dim = clean(df, key, vector)
    id_field = v.schema["vec_id"].dataType
    kind = id_field.simpleString()
    asking = some(v, queries)
    if not dim or asking.isEmpty():
        return spark.createDataFrame([], f"vec_id {kind}, rank long, match_id {kind}, score double")
    arrow = to_arrow_type(id_field)
    blocks = _by_length(v, block * group, dim, block, arrow, "blocks")
    asked = _by_length(asking, query_block, dim, query_block, arrow, "queries").select((F.shiftleft("grp", 32) + F.col("seq")).alias("qblock"), F.col("ids").alias("qids"), F.col("hashes").alias("qh"), F.col("x").alias("qx"))
    # one number a group
    by_group = {r.grp: r.longest for r in blocks.groupBy("grp").agg(F.max("longest").alias("longest")).collect()}
    longest = np.full(max(by_group) + 1, -np.inf)
    longest[list(by_group)] = list(by_group.values())
    turn = spark.sparkContext.broadcast(rotation(v, dim))
    place = F.row_number().over(Window.partitionBy("qblock", "qrow").orderBy(F.col("score").desc(), F.col("match_id").asc_nulls_first()))
    found, known = None, asked.withColumn("floors", F.lit(None).cast("array<struct<qrow:int,score:double>>"))
    low, high = 0, 1
    while low < len(longest):
        pairs = written(known.mapInArrow(_open(dim, longest, low, high), "qblock long, grp long"), "pairs")
        if pairs.isEmpty():
            # lengths only fall, and floors only rise
            break
        left = known.join(pairs, "qblock").groupBy("qblock", "grp")
        right = blocks.join(pairs, "grp").groupBy("qblock", "grp")
        new = left.cogroup(right).applyInArrow(_searched(dim, k, head, turn, arrow), f"qblock long, qrow int, vec_id {kind}, match_id {kind}, score double")
        every = new if found is None else found.drop("rank").unionByName(new)
        found = written(every.withColumn("rank", place.cast("long")).where(F.col("rank") <= k), "found")
        floors = found.where(F.col("rank") == k).groupBy("qblock").agg(F.collect_list(F.struct("qrow", "score")).alias("floors"))
        known = asked.join(floors, "qblock", "left")
        low, high = high, 4 * high
    return found.select("vec_id", "rank", "match_id", "score")


def oracle(k: int = K, queries: str = "true") -> str:
    return f"""
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
p AS (SELECT a.vec_id, b.vec_id AS match_id, list_inner_product(a.x, b.x) AS s FROM (SELECT * FROM e WHERE {queries}) a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match_id) AS rank FROM p)
SELECT vec_id, rank, match_id, round(s, 6) AS score FROM r WHERE rank <= {k}
"""

"""Near-duplicate documents by SimHash and random bit sampling.

Each document gets a fingerprint of 256 bits: for every bit, the majority over the hashes of its
shingles (pairs of consecutive words, lower case, without punctuation). Several tables each sample
coordinates of the fingerprint in an order of their own. Documents that agree in the first sampled
coordinates share a bucket. Their number follows from the number of fingerprints, so that buckets have
about the cap; and the number of tables from theirs, so that a pair at the full distance shares a
bucket of some table with a chance of RECALL at least, however many fingerprints there are. In each
bucket all pairs are verified by the full distance, but those that are in one group already: a bucket
over the cap is first split by one more coordinate, again and again, for the groups that are found so,
and then all of it outside its largest group is held against the whole. Fingerprints that are equal are
one from the start, so that thousands of copies cost nothing; verified pairs are joined to groups
across tables. Such a group can be a chain: a member that is further than REACH from the one that stays
leaves it, with its copies, so that no document goes for one that it doesn't resemble.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm import text as tx
from treeframe.llm.graph import components
from treeframe.llm.repeats import fresh_name, keyed
from treeframe.llm.store import written

BITS = 256
#: words of a shingle; fewest tables; most bits in which near copies differ; fingerprints of a bucket
SHINGLE, TABLES, DISTANCE, CAP = 2, 24, 52, 1024
#: most bits in which a document differs from the one of its group that stays, as a multiple of the distance
REACH = 1.5
#: sampled coordinates a bucket begins with, and rows that a task's group of buckets should have
FIRST_BITS, GROUP_ROWS = 6, 20_000
#: least chance that a pair at the full distance is found; tables that are shuffled at once
RECALL, ROUND = 0.9, 64
_CHUNK = 1 << 20
#: pairs that are compared at once
_PAIRS = 1 << 18
_SEEDS = np.array([0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
#: for each byte value, +1 or -1 for each of its bits, the highest first
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """256 bits, as 32 bytes, for each document.

    A document with fewer words than a shingle has all its words as its only one; one without a word
    has its raw text.
    """
    n = len(offsets) - 1
    low = tx.folded(data)
    starts, ends, first = tx.words(low, offsets, tx.MARK)
    per_row = np.diff(first)
    hashes = tx.Rolling(low)(starts, ends)
    over = tx.word_hashes(hashes)
    has = per_row >= shingle
    counts = np.where(has, per_row - shingle + 1, 0)
    at = tx.ragged(first[:-1][has], counts[has])
    short = np.flatnonzero(~has)
    raw = tx.Rolling(data)
    value = np.r_[over(at, at + shingle), np.where(per_row[short] > 0, over(first[short], first[short + 1]), raw(offsets[short], offsets[short + 1]))]
    row = np.r_[np.repeat(np.arange(n), counts), short] * 256
    bits = np.empty((n, BITS), bool)
    for k, seed in enumerate(_SEEDS):
        view = tx.mix(value ^ seed).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(row + view[:, byte], minlength=n * 256).reshape(n, 256).astype(np.float32)
            bits[:, (k * 8 + byte) * 8 : (k * 8 + byte + 1) * 8] = seen @ _SIGNS > 0
    return np.packbits(bits, axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            sigs = [fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in tx.pieces(offsets, _CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rh"), _fixed(np.concatenate(sigs) if sigs else np.zeros((0, 32), np.uint8))], ["doc_id", "rh", "sig"])

    return run


def chance(bits: int, distance: int) -> float:
    """Of two fingerprints that differ in `distance` bits, that they agree in so many sampled ones."""
    return math.prod(max(0, BITS - distance - i) / (BITS - i) for i in range(bits))


def layout(n: int, tables: int, distance: int, cap: int) -> tuple[int, int, int]:
    """For n fingerprints: coordinates of a group of buckets, of a bucket, and the number of tables."""
    log = lambda rows: max(0, math.ceil(math.log2(max(1, n / rows))))
    group = log(GROUP_ROWS)
    bits = min(64, max(group, FIRST_BITS, log(cap)))
    p = chance(bits, distance)
    if not p:
        raise ValueError(f"fingerprints at a distance of {distance} share no bucket of {bits} bits")
    return group, bits, tables if p == 1 else max(tables, math.ceil(math.log(1 - RECALL) / math.log1p(-p)))


@lru_cache(4)
def samples(tables: int, seed: int = 7) -> np.ndarray:
    """For each table, 64 coordinates in the order in which they are used."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(BITS)[:64] for _ in range(tables)])


def sampled(sigs: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """The coordinates of each fingerprint as one number, the first the highest bit."""
    bits = np.unpackbits(sigs, axis=1)[:, coordinates]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").reshape(-1).astype(np.uint64)


def _spread(tables: int, bits: int, first: int = 0):
    """A row for each table from the first on: the group of buckets and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = samples(tables)
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("sig"))
            sigs = data.reshape(-1, 32)
            for t in range(first, tables):
                group = (sampled(sigs, order[t]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sigs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sigs), t, np.int32)), pa.array(group.astype(np.int32)), batch.column("sig")], ["t", "g", "sig"])

    return run


def close_pairs(sigs: np.ndarray, key: np.ndarray, first_bits: int, cap: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the distance that share a bucket."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], len(key)
    word = [np.ascontiguousarray(c) for c in np.ascontiguousarray(sigs[order]).view(np.uint64).T]
    end = np.zeros(n, np.int64)  # where each row's bucket ends
    todo, bits = np.arange(n), first_bits
    while len(todo):
        prefix = key[todo] >> np.uint64(64 - bits) if bits else np.zeros(len(todo), np.uint64)
        begin = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (todo[1:] != todo[:-1] + 1)])
        size = np.diff(np.r_[begin, len(todo)])
        done = np.repeat((size <= cap) | (bits >= 64), size)
        last = np.repeat(todo[begin + size - 1] + 1, size)
        end[todo[done]] = last[done]
        todo, bits = todo[~done], bits + 1
    left, right = [], []
    room = end - np.arange(n)
    for d in range(1, int(room.max(initial=0))):
        near = (np.bitwise_count(word[0][:-d] ^ word[0][d:]) + np.bitwise_count(word[1][:-d] ^ word[1][d:])).astype(np.uint16)
        near += np.bitwise_count(word[2][:-d] ^ word[2][d:])
        near += np.bitwise_count(word[3][:-d] ^ word[3][d:])
        hit = np.flatnonzero((near <= distance) & (room[:-d] > d))
        if len(hit):
            left.append(order[hit])
            right.append(order[hit + d])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows, the least row of its component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def rest_of_large(sigs: np.ndarray, key: np.ndarray, bits: int, cap: int, distance: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the distance in buckets over the cap, but those within a bucket's largest component."""
    order = np.argsort(key >> np.uint64(64 - bits), kind="stable") if bits else np.arange(len(key))
    prefix = key[order] >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    cuts = np.r_[np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
    word = np.ascontiguousarray(sigs).view(np.uint64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(np.diff(cuts) > cap):
        rows = order[cuts[k] : cuts[k + 1]]
        roots, which, size = np.unique(root[rows], return_inverse=True, return_counts=True)
        inside = which == size.argmax()
        rows, outside = np.r_[rows[~inside], rows[inside]], int((~inside).sum())
        own = [np.ascontiguousarray(c) for c in word[rows].T]
        step = max(1, _PAIRS // len(rows))
        for i in range(0, outside, step):
            j = min(outside, i + step)
            near = np.bitwise_count(own[0][i:j, None] ^ own[0][i:]).astype(np.uint16)
            for w in own[1:]:
                near += np.bitwise_count(w[i:j, None] ^ w[i:])
            a, b = np.nonzero(near <= distance)
            new = a < b
            left.append(rows[a[new] + i])
            right.append(rows[b[new] + i])
    return np.concatenate(left), np.concatenate(right)


def _verified(tables: int, bits: int, cap: int, distance: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        data, _, _ = tx.string_bytes(table.column("sig"))
        sigs = data.reshape(-1, 32)
        key = sampled(sigs, samples(tables)[t])
        a, b = close_pairs(sigs, key, bits, cap, distance)
        root = local_roots(len(sigs), a, b)
        c, d = rest_of_large(sigs, key, bits, cap, distance, root)
        if len(c):
            root = local_roots(len(sigs), np.r_[np.arange(len(root)), c], np.r_[root, d])
        member = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([_fixed(sigs[member]), _fixed(sigs[root[member]])], names=["a", "b"])

    return run


def _differ(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    word = lambda c, k: F.conv(F.hex(F.substring(F.col(c), 8 * k + 1, 8)), 16, -10).cast("long")
    return sum((F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(BITS // 64)), F.lit(0))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tables: int = TABLES, distance: int = DISTANCE, cap: int = CAP) -> DataFrame:
    """doc_id, rh (hash of the text), kept_doc_id, kept_rh, for each row that repeats the kept one of its group.

    The kept row has the least (doc_id, rh), a null doc_id being the least. Null texts are in no group;
    empty texts are copies of each other; of rows with the same doc_id and text all but one are listed,
    with themselves as the kept. Groups are connected components of pairs within the distance, without
    the members that are further than REACH times that from the kept row, whose copies are a group of
    their own. There are `tables` at least, and more where there are many fingerprints: see layout. Long
    texts are whole; other columns may have any names; an empty table gives none.
    """
    own = keyed(docs).where(F.col("text").isNotNull())
    id_type = own.schema["doc_id"].dataType.simpleString()
    sigs = written(own.mapInArrow(_fingerprinted(shingle), f"doc_id {id_type}, rh long, sig binary"), "fingerprints")
    distinct = written(sigs.select("sig").distinct(), "distinct")
    group, bits, tables = layout(distinct.count(), tables, distance, cap)
    edges = None
    for first in range(0, tables, ROUND):
        # shuffle files of one round at a time
        spread = distinct.mapInArrow(_spread(min(tables, first + ROUND), group, first), "t int, g int, sig binary")
        found = spread.groupBy("t", "g").applyInArrow(_verified(tables, bits, cap, distance), "a binary, b binary")
        found = written(found, "edges") if tables > ROUND else found
        edges = found if edges is None else edges.union(found)
    stars = components(edges)
    grouped = sigs.join(stars, sigs.sig == stars.node, "left").select("doc_id", "rh", "sig", F.coalesce("root", "sig").alias("root"))
    # equal fingerprints have one root, so that all are in one task
    by_root = Window.partitionBy("root").orderBy("doc_id", "rh")
    by_sig = Window.partitionBy("root", "sig").orderBy("doc_id", "rh")
    return (
        grouped.withColumns({"k": F.row_number().over(by_root), "kept": F.first(F.struct("doc_id", "rh")).over(by_root), "kept_sig": F.first("sig").over(by_root)})
        .withColumn("far", _differ("sig", "kept_sig") > int(REACH * distance))
        .withColumns({"k": F.when(F.col("far"), F.row_number().over(by_sig)).otherwise(F.col("k")), "kept": F.when(F.col("far"), F.first(F.struct("doc_id", "rh")).over(by_sig)).otherwise(F.col("kept"))})
        .where("k > 1")
        .select("doc_id", "rh", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.rh").alias("kept_rh"))
    )


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, tables: int = TABLES, distance: int = DISTANCE, cap: int = CAP) -> DataFrame:
    """Pairs (doc_id, kept_doc_id): the second, one for each group, stays, and the first is a near copy. See near_duplicates, also for nulls and ties."""
    return near_duplicates(docs, shingle, tables, distance, cap).select("doc_id", "kept_doc_id")


def without_near_duplicates(docs: DataFrame, **parameters: int) -> DataFrame:
    """One document of each group, with all columns; documents in no group, null texts among them, stay.

    Of rows with one doc_id and text the one whose columns have the least hash stays.
    """
    found = near_duplicates(docs, **parameters)
    rh, kd, kn, k, d, n, r = (fresh_name(docs, x) for x in ("tf_rh", "tf_kd", "tf_kn", "tf_k", "tf_d", "tf_n", "tf_r"))
    text_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    # a kept document's own later rows are told apart by number, not by name
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("rh") == F.col("kept_rh"))))
    gone = gone.select(text_id("doc_id").alias(d), F.col("doc_id").isNull().alias(n), F.col("rh").alias(r)).distinct()
    have = docs.withColumns({rh: F.xxhash64("text"), kd: text_id("doc_id"), kn: F.col("doc_id").isNull()})
    left = have.join(gone, (have[kd] == gone[d]) & (have[kn] == gone[n]) & (have[rh] == gone[r]), "left_anti")
    rows = left.withColumn(k, F.row_number().over(Window.partitionBy(kd, kn, rh).orderBy(every)))
    return rows.where((F.col(k) == 1) | F.col("text").isNull()).drop(rh, kd, kn, k)

"""Exact search for passages of at least T words that occur more than once in a corpus.

A *window* is T consecutive words (runs of bytes other than ASCII white space) of one document. A
window is a repeat if the same words occur earlier: in a document of lower (doc_id, hash of its
text), or at a lower position of the same document. The words covered by repeats form maximal
spans, the result. The first occurrence of everything stays.

How it stays exact without comparing everything with everything:

1. Every window has a minimizer, the least hash among its k-word pieces. Equal windows have equal
   minimizers, so windows that share a minimizer with no other passage can't be repeats. Consecutive
   windows with the same minimizer are one *passage* (at most 2T - k words), for which one row of
   numbers is shuffled by minimizer; no text moves.
2. Where all of a passage's words occurred before in another passage (128 bits of hash), it is a
   repeat as a whole: copies are settled here, in the JVM, however many there are.
3. Only the first of each distinct passage whose minimizer has several goes on, with its text, to the
   shard of its minimizer. A matcher (suffix automaton or suffix array) finds there which of its
   windows occur in earlier passages, comparing words, not hashes.
4. A minimizer may be hot: a line that stands in a part of all documents, each time between other words.
   Its passages (all, if it has more than HOT_ROWS; else the distinct ones, if more than HOT_PASSAGES)
   don't go to one shard, but are cut into their windows, each of which is a key of its own, of 128 bits
   of hash. The first of each key is found by partial sums in each task before anything is shuffled.

So copies and the windows of hot minimizers are told by hashes, everything else by words. All ways give the
same spans; the bounds only say which is taken.

Null texts have no windows. Rows with the same doc_id and text are one document. A null doc_id comes
before all others. Only doc_id and text are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm import text as tx
from treeframe.llm.store import written

#: words in a window, and in the pieces whose hashes give the minimizer
WINDOW, PIECE = 50, 8
#: words of distinct passages a shard should have
SHARD_WORDS = 60_000
#: passages of one minimizer that a task sorts, and distinct ones that a shard may get of it
HOT_ROWS, HOT_PASSAGES = 1_000_000, 4_096
#: keys that are broadcast, of up to 40 bytes each
BROADCAST_KEYS = 200_000
_CHUNK = 1 << 20

#: (passages in order, as lists of words; T) -> for each, the numbers of its windows that occur in earlier ones
Matcher = Callable[[list[list[bytes]], int], list[list[int]]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash of the text, which together name a document."""
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("rh"), F.col("text"))


def passages_of(data: np.ndarray, offsets: np.ndarray, window: int, piece: int) -> dict[str, np.ndarray]:
    """The passages of some documents: row, first word in it, number of windows, minimizer, two hashes."""
    starts, ends, first = tx.words(data, offsets)
    n = len(starts)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "w0", "nw", "m", "h1", "h2")}
    if n < window:
        return empty
    hashes = tx.Rolling(data)(starts, ends)
    h1, h2 = tx.word_hashes(hashes), tx.word_hashes(hashes, second=True)
    at = np.arange(n - piece + 1)
    least, where = tx.sliding_min(h1(at, at + piece), window - piece + 1)
    per_row = np.diff(first)
    has = per_row >= window
    valid = tx.ragged(first[:-1][has], per_row[has] - window + 1)
    if not len(valid):
        return empty
    pos = where[valid]
    fresh = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    begin, count = valid[fresh], np.diff(np.r_[fresh, len(valid)])
    end = begin + count + window - 1
    row = np.searchsorted(first, begin, "right") - 1
    return {"row": row, "w0": begin - first[row], "nw": count, "m": least[begin].view(np.int64), "h1": h1(begin, end).view(np.int64), "h2": h2(begin, end).view(np.int64)}


def _passages(window: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            for i, j in tx.pieces(offsets, _CHUNK):
                p = passages_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, piece)
                row = pa.array(p["row"] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("rh").take(row), pa.array(p["w0"].astype(np.int32)), pa.array(p["nw"].astype(np.int32)), *(pa.array(p[k]) for k in ("m", "h1", "h2"))],
                    ["doc_id", "rh", "w0", "nw", "m", "h1", "h2"],
                )

    return run


def _cut(window: int):
    """The passages' words, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            lists = batch.column("passages")
            counts = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            w0, nw, shard = (flat.field(k).to_numpy() for k in ("w0", "nw", "shard"))
            ends_of = np.cumsum(counts)
            for i, j in tx.pieces(offsets, _CHUNK):
                starts, ends, first = tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lo, hi = (int(ends_of[i - 1]) if i else 0), int(ends_of[j - 1])
                row = np.repeat(np.arange(i, j), counts[i:j])
                a = starts[first[row - i] + w0[lo:hi]] + offsets[i]
                b = ends[first[row - i] + w0[lo:hi] + nw[lo:hi] + window - 2] + offsets[i]
                take = pa.array(row)
                out = [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[lo:hi]), batch.column("doc_id").take(take), batch.column("rh").take(take), pa.array(w0[lo:hi]), pa.array(out, pa.binary())],
                    ["shard", "doc_id", "rh", "w0", "piece"],
                )

    return run


def _windows(window: int):
    """The windows of pieces of text: two hashes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("piece"))
            for i, j in tx.pieces(offsets, _CHUNK):
                sub = data[offsets[i] : offsets[j]]
                starts, ends, first = tx.words(sub, offsets[i : j + 1] - offsets[i])
                hashes = tx.Rolling(sub)(starts, ends)
                count = np.diff(first) - window + 1
                at = tx.ragged(first[:-1], count)
                own = np.repeat(np.arange(i, j), count)
                w = batch.column("w0").to_numpy()[own] + at - np.repeat(first[:-1], count)
                h1, h2 = (tx.word_hashes(hashes, second)(at, at + window).view(np.int64) for second in (False, True))
                row = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("rh").take(row), pa.array(w.astype(np.int32)), pa.array(h1), pa.array(h2)], ["doc_id", "rh", "w", "h1", "h2"])

    return run


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], how: str, hot_rows: int) -> DataFrame:
    """A join with a table that has how often (tf_n) each key comes in the rows: broadcast if it has few keys; else only
    those that come more than hot_rows times, of which there are at most rows / hot_rows."""
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    most, rest = F.broadcast(keys.where(F.col("tf_n") > hot_rows)), keys.where(F.col("tf_n") <= hot_rows)
    return rows.join(most, on, how).unionByName(rows.join(most, on, "left_anti").join(rest, on, how))


def _later(windows: DataFrame, window: int, hot_rows: int) -> DataFrame:
    """Of windows, those that occurred before: (doc_id, rh, w, n)."""
    windows = written(windows, "windows")
    often = written(windows.groupBy("h1").agg(F.count("*").alias("tf_n")).where("tf_n > 1"), "often")
    again = _joined(windows, often, ["h1"], "left_semi", hot_rows)
    firsts = again.groupBy("h1", "h2").agg(F.count("*").alias("tf_n"), F.min(F.struct("doc_id", "rh", "w")).alias("tf_first"))
    firsts = written(firsts.where("tf_n > 1"), "firsts")
    later = _joined(again, firsts, ["h1", "h2"], "inner", hot_rows).where(~F.struct("doc_id", "rh", "w").eqNullSafe(F.col("tf_first")))
    return later.select("doc_id", "rh", "w", F.lit(window).alias("n"))


def _matched(window: int, matcher: Matcher):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("rh", "ascending"), ("w0", "ascending")]).combine_chunks()
        # nulls come last in Arrow's order, and first in ours
        null = np.asarray(table.column("doc_id").is_null())
        order = np.argsort(~null, kind="stable")
        key = table.select(["doc_id", "rh", "w0"]).take(pa.array(order))
        raw = table.column("piece").take(pa.array(order)).to_pylist()
        doc, rh, w0 = key.column("doc_id").to_pylist(), key.column("rh").to_pylist(), key.column("w0").to_pylist()
        keep = [i for i in range(len(raw)) if not i or (doc[i], rh[i], w0[i]) != (doc[i - 1], rh[i - 1], w0[i - 1])]
        found: tuple[list, list, list, list] = ([], [], [], [])
        for i, hits in zip(keep, matcher([raw[i].split() for i in keep], window)):
            k = 0
            while k < len(hits):
                e = k
                while e + 1 < len(hits) and hits[e + 1] == hits[e] + 1:
                    e += 1
                for col, v in zip(found, (doc[i], rh[i], w0[i] + hits[k], e - k + window)):
                    col.append(v)
                k = e + 1
        kinds = (table.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds)], names=["doc_id", "rh", "w", "n"])

    return run


def repeated_spans(docs: DataFrame, matcher: Matcher, window: int = WINDOW, piece: int = PIECE, shard_words: int = SHARD_WORDS, hot_rows: int = HOT_ROWS, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """The maximal spans covered by repeats: doc_id, rh (the text's hash), start_word, n_words."""
    if not 1 <= piece <= window:
        raise ValueError("1 <= piece <= window")
    own = keyed(docs)
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = written(own.mapInArrow(_passages(window, piece), f"doc_id {id_type}, rh long, w0 int, nw int, m long, h1 long, h2 long"), "rows")
    # at most rows / hot_rows minimizers
    hot = written(rows.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("m"), "hot")
    same = Window.partitionBy("m", "h1", "h2").orderBy("doc_id", "rh", "w0")
    of_min = Window.partitionBy("m")
    # one shuffle, by minimizer: both windows are satisfied by it
    ranked = (
        rows.join(F.broadcast(hot), "m", "left_anti")
        .repartition("m")
        .withColumn("first", F.rank().over(same) == 1)
        .withColumn("distinct", F.count_if("first").over(of_min))
        .where(~F.col("first") | (F.col("distinct") > 1))
        .withColumn("heavy", F.col("first") & (F.col("distinct") > hot_passages))
        .select("doc_id", "rh", "w0", "nw", "m", "first", "heavy")
    )
    ranked = written(ranked, "passages")
    light = ranked.where("first and not heavy")
    size, heavy = ranked.agg(F.sum(F.when(F.col("first") & ~F.col("heavy"), F.col("nw") + window - 1)), F.count_if("heavy")).first()
    shards = max(1, -(-(size or 0) // shard_words))

    apart = bool(heavy) or not hot.isEmpty()
    columns = ["doc_id", "rh", "w0", "nw"]
    passages = light.select(*columns, F.pmod("m", F.lit(shards)).cast("long").alias("shard"))
    if apart:
        alone = ranked.where("heavy").select(columns).unionByName(rows.join(F.broadcast(hot), "m", "left_semi").select(columns))
        passages = passages.unionByName(alone.withColumn("shard", F.lit(-1).cast("long")))
    wanted = passages.groupBy("doc_id", "rh").agg(F.collect_list(F.struct("w0", "nw", "shard")).alias("passages")).withColumnsRenamed({"doc_id": "d", "rh": "r"})
    cut = own.join(wanted, own.doc_id.eqNullSafe(wanted.d) & (own.rh == wanted.r)).select("doc_id", "rh", "text", "passages")
    pieces = cut.mapInArrow(_cut(window), f"shard long, doc_id {id_type}, rh long, w0 int, piece binary")
    # texts are shuffled once for both
    pieces = written(pieces, "pieces") if apart else pieces
    partial = pieces.where("shard >= 0").groupBy("shard").applyInArrow(_matched(window, matcher), f"doc_id {id_type}, rh long, w int, n int")
    spans = ranked.where(~F.col("first")).select("doc_id", "rh", F.col("w0").alias("w"), (F.col("nw") + window - 1).alias("n")).unionByName(partial)
    if apart:
        windows = pieces.where("shard < 0").mapInArrow(_windows(window), f"doc_id {id_type}, rh long, w int, h1 long, h2 long")
        spans = spans.unionByName(_later(windows, window, hot_rows))
    return merged(spans)


def merged(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch, joined."""
    before = Window.partitionBy("doc_id", "rh").orderBy("w", "n")
    return (
        spans.withColumn("reach", F.max(F.col("w") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("w") <= F.col("reach"), 0).otherwise(1)).over(before))
        .groupBy("doc_id", "rh", "island")
        .agg(F.min("w").cast("long").alias("start_word"), (F.max(F.col("w") + F.col("n")) - F.min("w")).cast("long").alias("n_words"))
        .drop("island")
    )


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    while base in have:
        base += "_"
    return base


def _removed(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(spans)
            old = batch.column(text)
            data, offsets, _ = tx.string_bytes(old)
            has = np.flatnonzero(np.asarray(lists.is_valid()))
            new: dict[int, str] = {}
            for i, cuts in zip(has.tolist(), lists.take(pa.array(has)).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                starts, _, _ = tx.words(raw, np.array([0, len(raw)]))
                edge = np.r_[starts, len(raw)]
                at, parts = 0, []
                for c in sorted(cuts, key=lambda c: c["start_word"]):
                    a, b = int(edge[c["start_word"]]), int(edge[c["start_word"] + c["n_words"]])
                    parts.append(raw[at:a].tobytes())
                    at = b
                parts.append(raw[at:].tobytes())
                new[i] = b"".join(parts).decode("utf-8", "replace")
            column = pa.array([new[i] if i in new else v for i, v in enumerate(old.to_pylist())], old.type) if new else old
            yield pa.RecordBatch.from_arrays([column if c == text else batch.column(c) for c in names if c != spans], [c for c in names if c != spans])

    return run


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with the spans cut out of text, and n_chars, if there, counted again.

    A document of which nothing is left goes. All other columns stay as they are, whatever their names.
    Nulls stay; rows with the same doc_id and text lose the same spans; an empty table stays empty.
    """
    if docs.isEmpty():
        return docs
    rh, d, r, cuts, was = (fresh_name(docs, x) for x in ("tf_rh", "tf_d", "tf_r", "tf_cuts", "tf_was"))
    lists = spans.groupBy("doc_id", "rh").agg(F.collect_list(F.struct("start_word", "n_words")).alias(cuts)).withColumnsRenamed({"doc_id": d, "rh": r})
    have = docs.withColumn(rh, F.xxhash64("text"))
    joined = have.join(lists, have["doc_id"].eqNullSafe(lists[d]) & (have[rh] == lists[r]), "left").drop(rh, d, r)
    joined = joined.withColumn(was, F.col(cuts).isNotNull())
    schema = joined.drop(cuts).schema
    out = joined.mapInArrow(_removed("text", cuts), schema)
    out = out.where(~F.col(was) | (F.trim("text") != "")).drop(was)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def reference_oracle(window: int) -> str:
    """The spans of documents that occur in benchmark, in SQL."""
    return f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM docs),
known AS (SELECT DISTINCT array_to_string(w[i + 1 : i + {window}], ' ') AS t
          FROM (SELECT w, unnest(range(0, len(w) - {window - 1})) AS i FROM (SELECT regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= {window})),
windows AS (SELECT doc_id, r, i, array_to_string(w[i + 1 : i + {window}], ' ') AS t
            FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {window - 1})) AS i FROM split WHERE len(w) >= {window})),
found AS (SELECT doc_id, r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM windows JOIN known USING (t)),
islands AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + {window} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM found)
SELECT doc_id, min(i) AS start_word, max(i) - min(i) + {window} AS n_words FROM islands GROUP BY doc_id, r, g
"""


def oracle(window: int = WINDOW) -> str:
    """The spans in SQL: every window as text, numbered by order of occurrence."""
    return f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM docs),
windows AS (SELECT doc_id, r, i, md5(array_to_string(w[i + 1 : i + {window}], ' ')) AS h
            FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {window - 1})) AS i FROM split WHERE len(w) >= {window})),
later AS (SELECT doc_id, r, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, r, i) AS k FROM windows) WHERE k > 1),
edges AS (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM later),
islands AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + {window} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM edges)
SELECT doc_id, min(i) AS start_word, max(i) - min(i) + {window} AS n_words FROM islands GROUP BY doc_id, r, g
"""

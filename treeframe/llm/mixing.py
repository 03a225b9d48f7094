"""Mixing sources to target weights by Pareto order sampling.

Each source gets a quota of rows in proportion to its target weight (largest remainders; whole numbers
throughout). In a source, a document expects quota x measure / sum of measures copies, its measure being
the bits of its length: 1 for one character, 12 for 2048. The whole part of that is certain. What
is missing to the quota is a sample of fixed size with unequal probabilities: with the fraction f that
remains and a uniform number u, documents are ranked by u / (1 - u) divided by f / (1 - f), and
the first of the ranking get a copy more. u comes from a hash of seed and doc_id, so that the sample
doesn't depend on partitions.

No source is sorted as a whole, however hot: a histogram of the rank variable says between which
bounds the last sampled document lies, and only the documents there (one bin in 4096) are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm.repeats import fresh_name
from treeframe.llm.store import written

SEED, BINS = 11, 4096
#: sources up to this number are broadcast
BROADCAST_SOURCES = 100_000


def _measure(length: str) -> Column:
    return F.when(F.col(length) > 0, F.length(F.bin(F.col(length).cast("long")))).otherwise(0).cast("long")


def quotas(docs: DataFrame, weights: Mapping[str | None, float] | None, total: int | None, source: str = "source", length: str = "n_chars") -> DataFrame:
    """source, total_measure, quota of each source that has documents of positive measure and a positive weight."""
    groups = docs.groupBy(F.col(source).alias("source")).agg(F.count_if(_measure(length) > 0).alias("n"), F.sum(_measure(length)).alias("total_measure")).where("n > 0")
    if weights is None:
        groups = groups.withColumn("weight", F.floor(F.sqrt(F.col("n").cast("double")) * 1e6).cast("decimal(20,0)"))
    else:
        if not weights or not all(0 <= v < math.inf for v in weights.values()):
            raise ValueError("weights must be given, finite, and not below 0")
        # in whole numbers, the largest being 2^52; none above 0 becomes 0
        top = max(weights.values()) or 1
        given = [(k, max(1, round(v / top * 2**52)) if v else 0) for k, v in weights.items()]
        table = docs.sparkSession.createDataFrame(given, f"s {docs.schema[source].dataType.simpleString()}, weight long").withColumn("weight", F.col("weight").cast("decimal(20,0)"))
        groups = groups.join(table, groups["source"].eqNullSafe(table["s"])).where("weight > 0").drop("s")
    every = Window.partitionBy()
    size = F.sum("n").over(every).cast("decimal(20,0)") if total is None else F.lit(total).cast("decimal(20,0)")
    wide = groups.withColumns({"size": size, "all": F.sum("weight").over(every).cast("decimal(30,0)")})
    share = wide.withColumns({"base": F.expr("cast(size * weight as decimal(38,0)) div cast(all as decimal(38,0))"), "rest": F.expr("cast(size * weight as decimal(38,0)) % cast(all as decimal(38,0))")})
    place = F.row_number().over(Window.orderBy(F.col("rest").desc(), F.col("source").asc_nulls_first()))
    missing = F.col("size") - F.sum("base").over(every)
    return share.withColumn("quota", (F.col("base") + F.when(place <= missing, 1).otherwise(0)).cast("long")).select("source", "total_measure", "quota")


def _joined(docs: DataFrame, table: DataFrame, source: str, few: bool) -> DataFrame:
    t = F.broadcast(table) if few else table
    return docs.join(t, docs[source].eqNullSafe(t["tf_source"])).drop("tf_source")


def copies(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, seed: int = SEED, name: str = "copies", source: str = "source", length: str = "n_chars"
) -> DataFrame:
    """The documents that get copies, with all columns, and how many.

    weights: of sources, relative to each other; sources without one get nothing. Without any, a source
    weighs the square root of its number of documents. total: rows of the mixture; without it, as many
    as there are documents of positive length. A null source is a source of its own. Documents whose
    length is null or 0 get no copies. Rows with the same doc_id draw the same number; ties of the
    ranking go to the lower doc_id, and between equal rows to either. An empty table gives none. Texts
    aren't read, however long. A column that is named as the result is replaced by it.
    """
    q, s, k, w, r, v, b, cut = (fresh_name(docs, x) for x in ("tf_quota", "tf_sum", "tf_missing", "tf_whole", "tf_rank", "tf_bin", "tf_bound", "tf_cut"))
    docs = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    given = written(quotas(docs, weights, total, source, length).withColumnRenamed("source", "tf_source"), "quotas")
    few = given.count() <= BROADCAST_SOURCES

    def drawn(df: DataFrame, table: DataFrame) -> DataFrame:
        """With the whole copies, the rank variable (null where nothing remains) and its bin."""
        at = _joined(df, table.withColumnsRenamed({"quota": q, "total_measure": s}), source, few).where(_measure(length) > 0)
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))
        rest = (F.col(q) * _measure(length)) % F.col(s)
        f = rest.cast("double") / F.col(s).cast("double")
        at = at.withColumns({w: F.expr(f"(`{q}` * ({_measure_sql(length)})) div `{s}`"), r: F.when(rest > 0, (u / (1 - u)) * ((1 - f) / f))})
        return at.withColumn(v, F.floor(F.col(r) / (1 + F.col(r)) * BINS).cast("int"))

    narrow = docs.select("doc_id", source, length)
    counts = drawn(narrow, given).groupBy(F.col(source).alias("tf_source"), v).agg(F.count("*").alias("n"), F.sum(w).alias("whole"))
    upto = Window.partitionBy("tf_source").orderBy(F.col(v).asc_nulls_first())
    own = Window.partitionBy("tf_source")
    steps = counts.withColumns({"below": F.coalesce(F.sum(F.when(F.col(v).isNotNull(), F.col("n")).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "whole": F.sum("whole").over(own)})
    need = F.col("quota") - F.col("whole")
    bounds = given.join(steps.withColumnRenamed("tf_source", "t"), F.col("tf_source").eqNullSafe(F.col("t"))).groupBy("tf_source", "total_measure", "quota").agg(
        # the bin that holds the last of the sample, and how many of it are taken
        F.max(F.struct(F.when(F.col(v).isNotNull() & (F.col("below") < need), F.col(v)).otherwise(-1).alias("bin"), (need - F.col("below")).alias("take"))).alias("at")
    )
    bounds = written(bounds.select("tf_source", "total_measure", "quota", F.col("at.bin").alias(b), F.when(F.col("at.bin") >= 0, F.col("at.take")).otherwise(0).alias(k)), "bounds")
    rows = drawn(docs, bounds)
    clear = rows.where(F.col(v).isNull() | (F.col(v) != F.col(b))).withColumn(name, F.col(w) + F.when(F.col(v) < F.col(b), 1).otherwise(0))
    edge = rows.where(F.col(v) == F.col(b)).withColumn(cut, F.row_number().over(Window.partitionBy(source).orderBy(r, F.col("doc_id").asc_nulls_first())))
    edge = edge.withColumn(name, F.col(w) + F.when(F.col(cut) <= F.col(k), 1).otherwise(0))
    every = [*docs.columns, name]
    return clear.select(every).unionByName(edge.select(every)).where(F.col(name) > 0)


def _measure_sql(length: str) -> str:
    return f"cast(case when `{length}` > 0 then length(bin(cast(`{length}` as bigint))) else 0 end as bigint)"


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture itself: each document as many times as it has copies, with the columns it had, whatever their names; see copies for nulls, ties and empty tables."""
    n = fresh_name(docs, "tf_copies")
    return copies(docs, weights, total, seed, n).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(n)


def oracle(seed: int = SEED) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN n_chars > 0 THEN length(bin(n_chars)) ELSE 0 END AS x FROM documents),
g AS (SELECT source, count(*) AS n, sum(x)::BIGINT AS s, floor(sqrt(count(*)::DOUBLE) * 1e6)::HUGEINT AS w FROM d WHERE x > 0 GROUP BY source),
t AS (SELECT *, (sum(n) OVER ())::HUGEINT AS total, (sum(w) OVER ())::HUGEINT AS aw FROM g),
b AS (SELECT *, (total * w) // aw AS base, (total * w) % aw AS rest FROM t),
q AS (SELECT source, s, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source NULLS FIRST) <= total - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b),
e AS (SELECT d.doc_id, d.source, quota, (quota * x) // s AS whole, (quota * x) % s AS rest, s,
             ((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE x > 0),
r AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) * ((1 - rest::DOUBLE / s::DOUBLE) / (rest::DOUBLE / s::DOUBLE)) END AS v, sum(whole) OVER (PARTITION BY source) AS sure FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id) AS k FROM r)
SELECT doc_id, source, copies FROM
  (SELECT doc_id, source, (whole + CASE WHEN v IS NOT NULL AND k <= quota - sure THEN 1 ELSE 0 END)::BIGINT AS copies FROM c) WHERE copies > 0
"""

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeframe.llm.store import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any comparable type to (node, root): root is the least node of its component.

    Only nodes with an edge to another appear, the roots among them not. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    by_a = Window.partitionBy("a")
    # a is the greater
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least(F.min("b").over(by_a), "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.withColumn("m", F.min("b").over(by_a))
        small = least.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

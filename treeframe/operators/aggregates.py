"""Aggregates over columns and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeframe.sources.csv import as_double, as_long


def cell_sum(cells: Column) -> Column:
    """The sum of those cells, texts as a CSV file has them, that are doubles and not whole numbers; 0.0 if none is."""
    return F.coalesce(F.sum(F.when(as_long(cells).isNull(), as_double(cells))), F.lit(0.0))


def column_sum(df: DataFrame, column: str, strict_types: bool = False) -> DataFrame:
    """total: the sum of a column, 0.0 if there is none.

    Strict: cells count by their own type, and only doubles are added: those of a column of doubles, none
    of one of whole numbers, and of a column of texts those that are written as doubles.
    """
    if strict_types:
        kind = df.schema[column].dataType.simpleString()
        if kind == "string":
            return df.agg(cell_sum(F.col(column)).alias("total"))
        return df.agg(F.coalesce(F.sum(F.when(F.lit(kind in ("double", "float")), F.col(column).cast("double"))), F.lit(0.0)).alias("total"))
    return df.agg(F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)).alias("total"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and nulls of each column, from one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def symbol_histogram(df: DataFrame, text: str) -> DataFrame:
    """byte and n over the UTF-8 bytes of a column, counted by each task before anything is shuffled."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            column = batch.column(0)
            _, offsets, data = column.buffers()
            if len(column) and data is not None:
                o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
                total += np.bincount(np.frombuffer(data, np.uint8)[o[0] : o[-1]], minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["byte", "n"])

    return df.select(F.col(text).cast("string")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def entropy(histogram: DataFrame) -> DataFrame:
    """total bytes, distinct_bytes, and bits a byte that an ideal coder would need."""
    s = histogram.agg(F.sum("n").alias("t"), F.count("*").alias("distinct_bytes"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    return s.select(F.col("t").alias("total_bytes"), "distinct_bytes", F.round(F.log2("t") - F.col("l") / F.col("t"), 6).alias("entropy_bits"))


def compression_ratio(pages: DataFrame) -> DataFrame:
    """By column: bytes before and after, and their ratio."""
    return pages.groupBy("column_name").agg(F.sum("uncompressed_size").alias("uncompressed"), F.sum("compressed_size").alias("compressed")).withColumn("ratio", F.col("uncompressed") / F.col("compressed"))

"""Spans of values: reading, gathering by position, slices, elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gather_array(array: Column | str, positions: Column | list[int]) -> Column:
    """The elements at positions from 0, in the order of the positions, which may repeat."""
    c = F.col(array) if isinstance(array, str) else array
    p = F.array(*[F.lit(i) for i in positions]) if isinstance(positions, list) else positions
    return F.transform(p, lambda i: F.try_element_at(c, i.cast("int") + 1))


def slice_array(array: Column | str, offset: int, length: int | None = None) -> Column:
    """`length` elements from an offset, or all that follow."""
    c = F.col(array) if isinstance(array, str) else array
    return F.slice(c, offset + 1, F.size(c) if length is None else F.lit(length))


def index_rows(spark: SparkSession, positions: list[int]) -> DataFrame:
    """Row numbers to gather, with their own order: position, row_index."""
    return spark.createDataFrame(list(enumerate(positions)), "position long, row_index long")


def gather_rows(rows: DataFrame, indices: DataFrame) -> DataFrame:
    """The rows at indices (position, row_index), as often as they come there; position gives the order."""
    return indices.join(rows, "row_index")


def subspan(rows: DataFrame, offset: int, length: int | None = None) -> DataFrame:
    """Rows by their number; the filter prunes stored row groups."""
    c = F.col("row_index")
    return rows.where(c >= offset if length is None else (c >= offset) & (c < offset + length))


def explode_typed(df: DataFrame, key: str, array: str, kind: str) -> DataFrame:
    """key, pos and val of every element that can be of the type; others are passed over."""
    return df.select(key, F.posexplode(array).alias("pos", "val")).select(key, F.col("pos").cast("long").alias("pos"), F.col("val").try_cast(kind).alias("val")).where(F.col("val").isNotNull())


def collect_span(df: DataFrame, order_by: str, column: str, *keys: str) -> DataFrame:
    """The column's values as an array by key, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(column).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(column))

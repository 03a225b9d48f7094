"""Reads of stored pages that pass over those whose bounds can't match."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.operators.pages import BYTE_ARRAY, DOUBLE, INT64, decode_pages
from treeframe.plans.pipeline import Pipeline

_NAME = {INT64: "long", DOUBLE: "double", BYTE_ARRAY: "string"}


def candidates(pages: DataFrame, kind: int, low: Any = None, high: Any = None) -> DataFrame:
    """The pages whose bounds meet low .. high; None is no bound. The filter reaches the scan of stored pages."""
    if low is not None:
        pages = pages.where(F.col(f"max_{_NAME[kind]}") >= F.lit(low))
    if high is not None:
        pages = pages.where(F.col(f"min_{_NAME[kind]}") <= F.lit(high))
    return pages


def range_scan(pages: DataFrame, column: str, kind: int, low: Any = None, high: Any = None, pipeline: Pipeline | None = None) -> DataFrame:
    """row_index and value of the rows in low .. high; payloads of other pages aren't decoded."""
    own = pages.where(F.col("column_name") == column)
    rows = decode_pages(candidates(own, kind, low, high), kind, pipeline)
    if low is not None:
        rows = rows.where(F.col("value") >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col("value") <= F.lit(high))
    return rows


def read_column(pages: DataFrame, column: str, kind: int, pipeline: Pipeline | None = None) -> DataFrame:
    return decode_pages(pages.where(F.col("column_name") == column), kind, pipeline)


def gather_from_pages(pages: DataFrame, column: str, kind: int, indices: DataFrame) -> DataFrame:
    """position and value for rows of indices (position, row_index); only pages that hold one are decoded.

    Pages of numbers have one number of rows, so that an index gives its page and the join is by page.
    """
    own = pages.where(F.col("column_name") == column)
    if kind == BYTE_ARRAY:
        wanted = own.join(indices.select("row_index"), (F.col("row_index") >= F.col("first_row_index")) & (F.col("row_index") < F.col("first_row_index") + F.col("n_rows")), "left_semi")
    else:
        per = own.agg(F.max("n_rows")).first()[0] or 1
        wanted = own.join(indices.select(F.expr(f"row_index div {per}").alias("tf_page")).distinct(), F.col("page_no") == F.col("tf_page"), "left_semi")
    return indices.join(decode_pages(wanted, kind), "row_index").select("position", "row_index", "value")

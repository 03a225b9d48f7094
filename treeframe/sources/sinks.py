"""Sinks: JSON and BSON documents, pages, Parquet in four configurations, and their sizes."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.functions import bson
from treeframe.sources.document import Document, Pairs, Table, plain

#: compression, dictionary, and columns in delta encoding
PARQUET = {
    "A": {"compression": "snappy", "parquet.enable.dictionary": "true"},
    "B": {"compression": "zstd", "parquet.enable.dictionary": "true"},
    "C": {"compression": "gzip", "parquet.enable.dictionary": "false"},
    "D": {"compression": "zstd", "parquet.enable.dictionary": "true"},
}
#: columns that configuration D writes in delta encoding, for which they have no dictionary, as files of version 2
DELTA = ("join_date",)


def rows_as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as compact JSON, with its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def rows_as_bson(df: DataFrame, key: str) -> DataFrame:
    """key and the BSON of each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            yield pd.DataFrame({key: batch[key], "bson": [bson.encode({k: v.item() if hasattr(v, "item") else v for k, v in r.items()}) for r in rows]})

    return df.mapInPandas(run, f"`{key}` {kind}, bson binary")


def table_as_columns(df: DataFrame, order_by: str | Sequence[str] | None = None) -> dict[str, list]:
    """A table of a document as {"Table": {column: cells}}; gathered on the driver, as a document is one value."""
    rows = (df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)) if order_by else df).collect()
    return {"Table": {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}}


def expanded(document: Document) -> object:
    """The document as plain values, with its tables in the places of their names."""

    def walk(v: object, path: str) -> object:
        if isinstance(v, Table):
            return table_as_columns(document.tables[path])
        if isinstance(v, Pairs):
            return {k: walk(x, f"{path}.{k}" if path else k) for k, x in v}
        if isinstance(v, list):
            return [walk(x, f"{path}[{i}]") for i, x in enumerate(v)]
        return plain(v)

    return walk(document.root, "")


def document_bson(document: Document) -> bytes:
    return bson.encode(expanded(document))


def document_json(document: Document) -> str:
    import json

    return json.dumps(expanded(document), separators=(",", ":"), ensure_ascii=False)


def write_nodes(document: Document, path: str) -> None:
    """The flat form: node rows as Parquet, and each table beside them."""
    document.node_table().write.parquet(f"{path}/nodes")
    for i, df in enumerate(document.tables.values()):
        df.write.parquet(f"{path}/tables/{i}")


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages by column, so that a read of one column lists only its files; payloads are compressed already."""
    pages.write.partitionBy("column_name").option("compression", "none").parquet(path)


def write_bytes(data: bytes, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def write_parquet(df: DataFrame, path: str, configuration: str = "A", delta: Sequence[str] = DELTA) -> None:
    """delta: columns that D writes in delta encoding; the others keep their dictionaries."""
    options = dict(PARQUET[configuration])
    if configuration == "D" and (own := [c for c in delta if c in df.columns]):
        options |= {"parquet.writer.version": "v2", **{f"parquet.enable.dictionary#{c}": "false" for c in own}}
    df.write.options(**options).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def parquet_report(df: DataFrame, folder: str) -> DataFrame:
    """configuration, seconds and bytes of each way to write the table."""
    import time

    rows = []
    for c in PARQUET:
        began = time.perf_counter()
        write_parquet(df, f"{folder}/{c}", c)
        rows.append((c, time.perf_counter() - began, stored_bytes(df.sparkSession, f"{folder}/{c}")))
    return df.sparkSession.createDataFrame(rows, "configuration string, seconds double, bytes long")


def size_report(df: DataFrame, pages: DataFrame, key: str | None = None) -> DataFrame:
    """Bytes of a table as rows of JSON (a line each), as rows of BSON, in plain pages and compressed; all are made, and counted where the rows are."""
    a = rows_as_json(df).agg(F.sum(F.octet_length("json") + 1).alias("json")).crossJoin(rows_as_bson(df, key or df.columns[0]).agg(F.sum(F.octet_length("bson")).alias("bson")))
    b = pages.agg(F.sum("uncompressed_size").alias("flat"), F.sum("compressed_size").alias("compressed"))
    return a.crossJoin(b).select(F.explode(F.create_map(*[x for c in ("json", "bson", "flat", "compressed") for x in (F.lit(c), F.col(c).cast("long"))])).alias("form", "bytes"))

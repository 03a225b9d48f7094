"""Columns as pages: assignment, plain encoding, statistics, codec chains, and back.

A page has at most page_bytes of plain values. Numbers have 8 bytes, little-endian, so that a page is a
fixed number of rows; strings have a length of 4 bytes and their own, and fill a page greedily. Nulls
keep their rows: they take no bytes, and a page that has some carries a bitmap.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from treeframe.functions import jvm
from treeframe.operators.order import scratch, with_row_index
from treeframe.plans.pipeline import Pipeline

PAGE_BYTES = 1 << 20
#: up to so many pages of a string column, where each begins is broadcast (8 bytes a page); of more, rows are joined to their pages
MOST_STARTS = 1 << 22
#: what is sent from Python at once, and a row group of stored pages, in bytes
_SENT, _GROUP = 1 << 22, 1 << 24
#: physical types, page types, encodings
INT64, DOUBLE, BYTE_ARRAY = 0, 1, 2
DATA_PAGE, PLAIN = 0, 0
_KINDS = {"tinyint": INT64, "smallint": INT64, "int": INT64, "bigint": INT64, "boolean": INT64, "float": DOUBLE, "double": DOUBLE, "string": BYTE_ARRAY}
_CAST = {INT64: "bigint", DOUBLE: "double", BYTE_ARRAY: "string"}
_ARROW = {INT64: pa.int64(), DOUBLE: pa.float64(), BYTE_ARRAY: pa.string()}

PAGE_SCHEMA = (
    "column_name string, page_no long, page_type int, physical_type int, encoding_type int, codecs array<string>, n_rows long, n_values long, first_row_index long, "
    "uncompressed_size long, compressed_size long, null_count long, distinct_count long, min_long long, max_long long, min_double double, max_double double, "
    "min_string string, max_string string, is_dictionary boolean, nulls binary, page_data binary"
)
_STEPS_SCHEMA, _CODECS = f"{PAGE_SCHEMA}, tf_steps string", 5


def physical_type(df: DataFrame, column: str) -> int:
    """int64 for whole numbers and booleans, double for floating point, byte array for strings."""
    name = df.schema[column].dataType.simpleString()
    if name not in _KINDS:
        raise TypeError(f"column {column} is {name}; cast it to long, double or string")
    return _KINDS[name]


def values(df: DataFrame, column: str, order_by: str | list[str], key: str | None = None) -> DataFrame:
    """row_index and value, as one of the three types; key, where a column is named; of strings the size, too."""
    kind = physical_type(df, column)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    own = df.select(*[F.col(k).alias(f"tf_k{i}") for i, k in enumerate(keys)], F.col(column).cast(_CAST[kind]).alias("value"), *([F.col(key).alias("key")] if key else []))
    if kind == BYTE_ARRAY:
        own = own.withColumn("size", _size())
    return with_row_index(own, [f"tf_k{i}" for i in range(len(keys))]).drop(*(f"tf_k{i}" for i in range(len(keys))))


def _size():
    """Plain bytes of a string value."""
    return F.coalesce(F.octet_length("value") + 4, F.lit(0)).cast("long")


def _fill(limit: int, starts: bool = False):
    """The page of each row, in the order of rows: the next begins where a string wouldn't fit. starts: only the first row of each page, and where rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the page that is open, and its bytes: none at first, as if it were full
        k, used, end = -1, limit + 1, 0
        for batch in batches:
            before = k
            size = batch.column("size").to_numpy()
            ends = np.r_[0, np.cumsum(size)]
            page = np.empty(len(size), np.int64)
            at = int(np.searchsorted(ends, limit - used, "right")) - 1 if used <= limit else 0
            page[:at] = k
            used += int(ends[at])
            while at < len(size):
                # a string over the limit has a page of its own
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
                k, used = k + 1, int(ends[to] - ends[at])
                page[at:to] = k
                at = to
            if starts:
                index = batch.column("row_index").to_numpy()
                end = int(index[-1]) + 1 if len(index) else end
                yield pa.RecordBatch.from_arrays([pa.array(index[np.flatnonzero(np.diff(page, prepend=before))])], ["row_index"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column("row_index"), pa.array(page)], ["row_index", "page"])
        if starts:
            yield pa.RecordBatch.from_arrays([pa.array([end])], ["row_index"])

    return run


def with_pages(rows: DataFrame, kind: int, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """row_index, value and page of every row."""
    if kind != BYTE_ARRAY:
        return rows.withColumn("page", F.expr(f"row_index div {max(1, page_bytes // 8)}"))
    numbered = _sizes(rows).mapInArrow(_fill(page_bytes), "row_index long, page long")
    return rows.drop("size").join(numbered, "row_index")


def _sizes(rows: DataFrame) -> DataFrame:
    """row_index and size, sorted: where a page begins depends on all before, so that sizes, not values, pass through one task."""
    sizes = rows.select("row_index", F.col("size") if "size" in rows.columns else _size().alias("size"))
    return sizes.repartition(1).sortWithinPartitions("row_index")


def page_statistics(df: DataFrame, column: str, order_by: str | list[str], page_bytes: int = PAGE_BYTES) -> DataFrame:
    """page, n_values, first_row_index, uncompressed_size, null_count, distinct_count, min_value, max_value."""
    kind = physical_type(df, column)
    paged = with_pages(values(df, column, order_by), kind, page_bytes)
    size = F.sum(F.octet_length("value") + 4) if kind == BYTE_ARRAY else 8 * F.count("value")
    return paged.groupBy("page").agg(
        F.count("value").alias("n_values"),
        F.min("row_index").alias("first_row_index"),
        F.coalesce(size, F.lit(0)).cast("long").alias("uncompressed_size"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.count_distinct("value").alias("distinct_count"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def plain_encode(values: Sequence, kind: int) -> bytes:
    """Values without nulls."""
    if kind == INT64:
        return np.asarray(values, "<i8").tobytes()
    if kind == DOUBLE:
        return np.asarray(values, "<f8").tobytes()
    return _with_lengths([v.encode() for v in values])


def _with_lengths(raw: Sequence[bytes]) -> bytes:
    return b"".join(x for r in raw for x in (len(r).to_bytes(4, "little"), r))


def _without_lengths(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def plain_decode(data: bytes, kind: int) -> list:
    if kind != BYTE_ARRAY:
        return np.frombuffer(data, "<i8" if kind == INT64 else "<f8").tolist()
    return [r.decode() for r in _without_lengths(data)]


def _values(data: bytes, kind: int, null: np.ndarray) -> pa.Array:
    """The values of a page, null where null says so."""
    if kind == BYTE_ARRAY:
        present = pa.array(_without_lengths(data), pa.binary()).cast(pa.string())
    else:
        present = pa.array(np.frombuffer(data, "<i8" if kind == INT64 else "<f8"), _ARROW[kind])
    return present.take(pa.array(np.where(null, 0, np.cumsum(~null) - 1), pa.int64(), mask=null)) if null.any() else present


def _nulls(r: dict) -> np.ndarray:
    n = r["n_rows"]
    return np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[:n].astype(bool) if r["null_count"] else np.zeros(n, bool)


def _page(column: str, kind: int, pipeline: Pipeline, values: pa.Array, page: int, first: int) -> list:
    """The row of PAGE_SCHEMA of a page's values, in order."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    present = values.drop_null()
    # strings stay bytes
    present = present.cast(pa.binary()).to_pylist() if kind == BYTE_ARRAY else present.to_numpy(zero_copy_only=False)
    raw = _with_lengths(present) if kind == BYTE_ARRAY else plain_encode(present, kind)
    data, taken = pipeline.compress_page(raw)
    low = high = None
    if len(present):
        if kind == BYTE_ARRAY:
            low, high = min(present).decode(), max(present).decode()
        else:
            real = present[~np.isnan(present)] if kind == DOUBLE else present
            # NaN is above all numbers
            high = present.max().item() if kind == INT64 or len(real) == len(present) else float("nan")
            low = real.min().item() if len(real) else float("nan")
    bounds = [None] * 6
    bounds[2 * kind], bounds[2 * kind + 1] = low, high
    nulls = np.packbits(null).tobytes() if null.any() else b""
    return [column, page, DATA_PAGE, kind, PLAIN, taken, len(values), len(present), first, len(raw), len(data), int(null.sum()), len(set(present)) if kind == BYTE_ARRAY else len(pd.unique(present)), *bounds, False, nulls, data]


def _encoded(columns: Sequence[tuple[str, int, Pipeline]], in_jvm: bool):
    """Of the rows of a page, a row for each column v0, v1 ...; tf_steps: codecs that are still to be run, if the JVM can."""
    schema = to_arrow_schema(StructType.fromDDL(_STEPS_SCHEMA))

    def row(column: str, kind: int, chain: Pipeline, *rest) -> list:
        if not (in_jvm and chain.fixed):
            return [*_page(column, kind, chain, *rest), ""]
        out = _page(column, kind, Pipeline(), *rest)
        out[_CODECS] = chain.names
        return [*out, ",".join(chain.names)]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_index")
        page, first = table.column("page")[0].as_py(), table.column("row_index")[0].as_py()
        rows = [row(c, kind, chain, table.column(f"v{i}").combine_chunks(), page, first) for i, (c, kind, chain) in enumerate(columns)]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _encode_paged(paged: DataFrame, columns: Sequence[tuple[str, int, Pipeline]]) -> DataFrame:
    """PAGE_SCHEMA of rows with a page; one Python call a page, and codecs in the JVM."""
    spark = paged.sparkSession
    in_jvm = jvm.available(spark)
    return _stepped(paged.groupBy("page").applyInArrow(_encoded(columns, in_jvm), _STEPS_SCHEMA), in_jvm)


def _stepped(pages: DataFrame, in_jvm: bool) -> DataFrame:
    """Pages after the codecs of tf_steps."""
    spark = pages.sparkSession
    if in_jvm:
        pages = pages.withColumn("page_data", jvm.run(spark, F.col("page_data"), F.col("tf_steps"), True))
        pages = pages.withColumn("compressed_size", F.octet_length("page_data").cast("long"))
    return pages.drop("tf_steps")


def _cut(column: str, chain: Pipeline, bounds: Broadcast, in_jvm: bool, schema: pa.Schema):
    """Pages of rows that follow each other; tf_whole is false where some rows of a page are elsewhere: then only its plain bytes are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = bounds.value
        page, first, n, parts, rows, held = -1, 0, 0, [], [], 0

        def close() -> None:
            nonlocal held
            whole = first == ends[page] and first + n == ends[page + 1]
            own = pa.concat_arrays([p.column("value") for p in parts])
            later = in_jvm or not whole
            row = _page(column, BYTE_ARRAY, Pipeline() if later else chain, own, page, first)
            if later:
                row[_CODECS] = chain.names
            keys = [[k for p in parts for k in p.column("key").to_pylist()]] if "key" in parts[0].schema.names else []
            rows.append([*row, ",".join(chain.names) if in_jvm else "", *keys, whole])
            held += len(row[-1])

        def sent() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            index = batch.column("row_index").to_numpy()
            of = np.searchsorted(ends[:-1], index, "right") - 1
            runs = np.r_[0, np.flatnonzero((np.diff(of) != 0) | (np.diff(index) != 1)) + 1, len(index)]
            for at, to in zip(runs[:-1].tolist(), runs[1:].tolist()):
                if at == to:
                    continue
                if n and (of[at] != page or index[at] != first + n):
                    close()
                    n, parts = 0, []
                    if held >= _SENT:
                        yield sent()
                if not n:
                    page, first = int(of[at]), int(index[at])
                parts.append(batch.slice(at, to - at))
                n += to - at
        if n:
            close()
        if rows:
            yield sent()

    return run


def _joined(column: str, chain: Pipeline, in_jvm: bool, schema: pa.Schema):
    """The page that all parts of it make."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("first_row_index").to_pylist()
        own = pa.concat_arrays([_values(p["page_data"], BYTE_ARRAY, _nulls(p)) for p in parts])
        row = _page(column, BYTE_ARRAY, Pipeline() if in_jvm else chain, own, parts[0]["page_no"], parts[0]["first_row_index"])
        if in_jvm:
            row[_CODECS] = chain.names
        keys = [[k for p in parts for k in p["keys"]]] if "keys" in schema.names else []
        rest = [parts[0]["tf_steps"], *keys, True]
        return pa.table([pa.array([x], f.type) for x, f in zip([*row, *rest], schema)], schema=schema)

    return run


def _encode_strings(rows: DataFrame, column: str, pipeline: Pipeline, page_bytes: int) -> DataFrame | None:
    """PAGE_SCHEMA of row_index and value, None over MOST_STARTS pages. Values aren't shuffled.

    Pages are cut from rows as they are stored, in order, and written; only pages whose rows are in several
    tasks' parts are put together by a shuffle. Rows in any other order give the same pages, with more to shuffle.
    """
    spark = rows.sparkSession
    in_jvm = pipeline.fixed and jvm.available(spark)
    path = f"{scratch(spark)}/pages-{uuid.uuid4().hex}"
    _sizes(rows).mapInArrow(_fill(page_bytes, starts=True), "row_index long").write.parquet(f"{path}-starts")
    found = spark.read.parquet(f"{path}-starts")
    if found.count() > MOST_STARTS:
        return None
    ends = spark.sparkContext.broadcast(np.sort(found.toArrow().column(0).to_numpy()))
    keyed = "key" in rows.columns
    ddl = StructType.fromDDL(f"{_STEPS_SCHEMA}{f', keys array<{rows.schema['key'].dataType.simpleString()}>' if keyed else ''}, tf_whole boolean")
    schema = to_arrow_schema(ddl)
    cut = rows.select("row_index", "value", *(["key"] if keyed else [])).mapInArrow(_cut(column, pipeline, ends, in_jvm, schema), ddl)
    cut.write.option("parquet.block.size", _GROUP).parquet(f"{path}-cut")
    parts = spark.read.schema(ddl).parquet(f"{path}-cut").where(~F.col("tf_whole"))
    parts.groupBy("page_no").applyInArrow(_joined(column, pipeline, in_jvm, schema), ddl).write.parquet(f"{path}-joined")
    pages = spark.read.schema(ddl).parquet(f"{path}-cut", f"{path}-joined").where("tf_whole")
    return _stepped(pages.drop("tf_whole"), in_jvm)


def encode_rows(rows: DataFrame, column: str, kind: int, pipeline: Pipeline | Sequence = (), page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Pages, as PAGE_SCHEMA, of row_index and value.

    A column key of the rows goes with pages of strings as keys, an array. Numbers: one shuffle by page, and one
    Python call a page.
    """
    chain = Pipeline.of(pipeline)
    if kind == BYTE_ARRAY:
        pages = _encode_strings(rows, column, chain, page_bytes)
        if pages is not None:
            return pages
    paged = with_pages(rows, kind, page_bytes).withColumnRenamed("value", "v0")
    pages = _encode_paged(paged, [(column, kind, chain)])
    if "key" in rows.columns:
        keys = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row_index", "key"))).alias("k")).select(F.col("page").alias("page_no"), F.col("k.key").alias("keys"))
        pages = pages.join(keys, "page_no").select(*pages.columns, "keys")
    return pages


def encode_column(df: DataFrame, column: str, order_by: str | list[str], pipeline: Pipeline | Sequence = (), page_bytes: int = PAGE_BYTES, key: str | None = None) -> DataFrame:
    """key: a column whose values go with the pages, and with the rows that are read from them."""
    return encode_rows(values(df, column, order_by, key), column, physical_type(df, column), pipeline, page_bytes)


def encode_table(df: DataFrame, pipelines: Mapping[str, Pipeline | Sequence], order_by: str | list[str], page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Pages of each named column; columns that aren't there are passed over."""
    found = [(c, physical_type(df, c), Pipeline.of(p)) for c, p in pipelines.items() if c in df.columns]
    if not found:
        raise ValueError("none of the columns is in the table")
    rows = _numbered(df, [c for c, *_ in found], order_by)
    parts = []
    # columns of numbers have the same pages: one shuffle for all of them
    fixed = [(i, x) for i, x in enumerate(found) if x[1] != BYTE_ARRAY]
    if fixed:
        own = rows.select("row_index", *(F.col(f"c{i}").alias(f"v{k}") for k, (i, _) in enumerate(fixed))).withColumn("page", F.expr(f"row_index div {max(1, page_bytes // 8)}"))
        parts.append(_encode_paged(own, [x for _, x in fixed]))
    parts += [encode_rows(rows.select("row_index", F.col(f"c{i}").alias("value")), *x, page_bytes) for i, x in enumerate(found) if x[1] == BYTE_ARRAY]
    return reduce(DataFrame.unionByName, parts)


def _numbered(df: DataFrame, columns: Sequence[str], order_by: str | list[str]) -> DataFrame:
    """row_index and the columns as c0, c1 ..., each as one of the three types; rows are numbered once for all."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    names = [f"k{i}" for i in range(len(keys))]
    own = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *(F.col(c).cast(_CAST[physical_type(df, c)]).alias(f"c{i}") for i, c in enumerate(columns)))
    return with_row_index(own, names).drop(*names)


def page_directory(df: DataFrame, columns: Sequence[str], order_by: str | list[str], page_bytes: int = PAGE_BYTES) -> DataFrame:
    """What pages of columns of numbers say of themselves, without their bytes: one aggregate by page for all columns.

    column_name, page_no, physical_type, n_values, first_row_index, uncompressed_size, null_count, distinct_count.
    """
    kinds = [physical_type(df, c) for c in columns]
    if BYTE_ARRAY in kinds:
        raise TypeError("pages of strings differ by column; see page_statistics")
    rows = _numbered(df, columns, order_by).withColumn("page_no", F.expr(f"row_index div {max(1, page_bytes // 8)}"))
    # a page bounds what a set holds
    stats = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("physical_type"), F.count(f"c{i}").alias("n_values"), (8 * F.count(f"c{i}")).alias("uncompressed_size"), F.count_if(F.col(f"c{i}").isNull()).alias("null_count"), F.size(F.collect_set(f"c{i}")).cast("long").alias("distinct_count")) for i, (c, k) in enumerate(zip(columns, kinds))]
    return rows.groupBy("page_no").agg(F.min("row_index").alias("first_row_index"), F.array(*stats).alias("s")).select("page_no", "first_row_index", F.explode("s").alias("s")).select("s.*", "page_no", "first_row_index")


def decode_pages(pages: DataFrame, kind: int, pipeline: Pipeline | None = None) -> DataFrame:
    """row_index and value of every row, and key where pages have keys; the chain is read from the pages unless it has functions of the user."""
    spark = pages.sparkSession
    in_jvm = (pipeline is None or all(isinstance(s, str) for s in pipeline.steps)) and jvm.available(spark)

    keyed = "keys" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                (r,) = own.select([c for c in own.schema.names if c != "keys"]).to_pylist()
                chain = Pipeline() if in_jvm else pipeline or Pipeline.of(r["codecs"])
                out = _values(chain.decompress(r["page_data"]), kind, _nulls(r))
                index = pa.array(np.arange(r["first_row_index"], r["first_row_index"] + r["n_rows"]))
                if keyed:
                    yield pa.RecordBatch.from_arrays([index, out, own.column("keys").flatten()], ["row_index", "value", "key"])
                else:
                    yield pa.RecordBatch.from_arrays([index, out], ["row_index", "value"])

    if in_jvm:
        steps = F.array_join("codecs", ",") if pipeline is None else F.lit(",".join(pipeline.names))
        pages = pages.withColumn("page_data", jvm.run(spark, F.col("page_data"), steps, False))
    own = f", key {pages.schema['keys'].dataType.elementType.simpleString()}" if keyed else ""
    return pages.select("codecs", "n_rows", "first_row_index", "null_count", "nulls", "page_data", *(["keys"] if keyed else [])).mapInArrow(run, f"row_index long, value {_CAST[kind]}{own}")


def column_metadata(pages: DataFrame) -> DataFrame:
    """One row a column: number of values, sizes, types, codecs."""
    return pages.groupBy("column_name").agg(
        F.sum("n_values").alias("number_of_values"),
        F.sum("uncompressed_size").alias("total_uncompressed_size"),
        F.sum("compressed_size").alias("total_compressed_size"),
        F.first("physical_type").alias("physical_type"),
        F.first("encoding_type").alias("encoding_type"),
        F.first("codecs").alias("compression_type"),
        F.count("*").alias("n_pages"),
    )


def split_pages(df: DataFrame, order_by: str | list[str], page_values: int) -> DataFrame:
    """The rows with the number of their page, of a fixed number of rows each."""
    return with_row_index(df, order_by).withColumn("page", F.expr(f"row_index div {page_values}"))

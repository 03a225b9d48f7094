"""Queries over the engine's operators, and the same in DuckDB's SQL. All run over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.functions import bson
from treeframe.operators import aggregates as ag
from treeframe.operators import encode as en
from treeframe.operators import navigate as nav
from treeframe.operators import pages as pg
from treeframe.operators import spans as sp
from treeframe.operators.order import scratch, with_row_index
from treeframe.plans.pipeline import GENERAL, TUNED, Pipeline
from treeframe.plans.scan import candidates, gather_from_pages, range_scan, read_column
from treeframe.sources import sinks
from treeframe.sources.csv import as_double, as_long, column_types, typed
from treeframe.sources.document import load_document, node_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: columns that together number the rows of lineitem
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_LINES = ", ".join(LINE_ORDER)
_POSITIONS = [7, 0, 63, 7, 12]
_ROWS = [5, 0, 5, 1499, 77]
_TEXT_PAGE = 1 << 16


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stored(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages, written by column and read again, as a reader finds them."""
    path = f"{scratch(spark)}/pages-{uuid.uuid4().hex}"
    sinks.write_pages(pages, path)
    return spark.read.schema(pages.schema).parquet(path)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# aggregates


@query("SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS total FROM lineitem")
def column_sum(spark, d):
    return ag.column_sum(_t(spark, d, "lineitem"), "l_extendedprice").select(F.round("total", 2).alias("total"))


_MIXED = "CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 1 THEN p_retailprice::VARCHAR ELSE p_brand END"


@query(f"SELECT round(coalesce(sum(CASE WHEN regexp_full_match(w, '[0-9]+[.][0-9]+') THEN w::DOUBLE END), 0.0), 2) AS total FROM (SELECT {_MIXED} AS w FROM part)")
def column_sum_strict(spark, d):
    """Cells of three types in one column: only the doubles are added."""
    m = F.col("p_partkey") % 3
    w = F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, F.col("p_retailprice").cast("string")).otherwise(F.col("p_brand"))
    return ag.column_sum(_t(spark, d, "part").select(w.alias("w")), "w", strict_types=True).select(F.round("total", 2).alias("total"))


@query("SELECT ascii(c) AS byte, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY 1")
def byte_histogram(spark, d):
    return ag.symbol_histogram(_t(spark, d, "part"), "p_name")


@query(
    "WITH h AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> '' GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS total_bytes, count(*) AS distinct_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits FROM h"
)
def entropy_bits(spark, d):
    return ag.entropy(ag.symbol_histogram(_t(spark, d, "part"), "p_name"))


# type inference


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN bool_and(t IS NULL OR t = '' OR regexp_full_match(t, '\\s*[+-]?[0-9]+')) THEN 'long' WHEN bool_and(t IS NULL OR t = '' OR try_cast(t AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type FROM (SELECT {c}::VARCHAR AS t FROM customer)"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
)
def infer_column_types(spark, d):
    df = _t(spark, d, "customer")
    types = column_types(df.select([F.col(c).cast("string").alias(c) for c in df.columns]))
    return spark.createDataFrame(list(types.items()), "column_name string, type string")


@query("SELECT c_custkey, c_acctbal, c_name FROM customer")
def infer_and_cast(spark, d):
    df = _t(spark, d, "customer")
    return typed(df.select([F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_acctbal", "c_name")]))


@query(
    "SELECT p_partkey, CASE WHEN regexp_full_match(w, '[0-9]+') THEN w::BIGINT ELSE -1 END AS as_long, CASE WHEN regexp_full_match(w, '[0-9]+([.][0-9]+)?') THEN w::DOUBLE ELSE -1.0 END AS as_double FROM "
    "(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR WHEN p_partkey % 3 = 1 THEN p_retailprice::VARCHAR ELSE p_brand END AS w FROM part)"
)
def cell_types(spark, d):
    m = F.col("p_partkey") % 3
    w = F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, F.col("p_retailprice").cast("string")).otherwise(F.col("p_brand"))
    return _t(spark, d, "part").select("p_partkey", F.coalesce(as_long(w), F.lit(-1).cast("long")).alias("as_long"), F.coalesce(as_double(w), F.lit(-1.0)).alias("as_double"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def document_table(spark, d):
    """A document that names a CSV file, through substitution and inference to the table at a path."""
    folder = f"{scratch(spark)}/document-{uuid.uuid4().hex}"
    _t(spark, d, "nation").write.csv(f"{folder}/nation.csv", header=True, quote='"', escape='"')
    package = json.dumps({"name": "nations", "resources": [{"path": "nation.csv", "note": "by key"}]})
    spark.createDataFrame([(package,)], "value string").coalesce(1).write.text(f"{folder}/package.json")
    return load_document(spark, f"{folder}/package.json", csv_prefix=f"{folder}/").table("resources[0].path")


# navigation


@query("SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_key_lookup(spark, d):
    return _t(spark, d, "events").select("event_id", nav.lookup("props", "$.k", "bigint").alias("k"))


@query("SELECT event_id, json_extract(props, '$.zzz') IS NULL AS missing FROM events")
def json_key_missing(spark, d):
    return _t(spark, d, "events").select("event_id", nav.lookup("props", "$.zzz", "bigint").isNull().alias("missing"))


@query("SELECT event_id, cast(json_extract(j, '$.resources[1].path') AS BIGINT) AS v FROM (SELECT event_id, '{\"resources\":[0,{\"path\":' || json_extract(props, '$.k') || '}]}' AS j FROM events)")
def json_path(spark, d):
    j = F.concat(F.lit('{"resources":[0,{"path":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    return _t(spark, d, "events").select("event_id", nav.lookup(j, "$.resources[1].path", "bigint").alias("v"))


@query("SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(props, '$.k') END AS type, count(*) AS n FROM events GROUP BY 1")
def json_types(spark, d):
    return _t(spark, d, "events").select(nav.type_of("props", "$.k").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS long_v FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')")
def typed_cell_filter(spark, d):
    return nav.typed_cells(node_table(_t(spark, d, "events"), "event_id", "props"), "long").select("event_id", "long_v")


@query("SELECT event_id, 2::BIGINT AS node_id, cast(json_extract(props, '$.k') AS BIGINT) AS long_v FROM events")
def head_children(spark, d):
    return node_table(_t(spark, d, "events"), "event_id", "props", children_of="k").select("event_id", "node_id", "long_v")


@query("SELECT event_id, 1::BIGINT AS node_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def head_lookup(spark, d):
    return nav.first_child_with_head(node_table(_t(spark, d, "events"), "event_id", "props"), "event_id", "k")


@query(
    "WITH k AS (SELECT count(*) AS n, sum(len(json_keys(props)))::BIGINT AS m, sum(list_sum(list_transform(json_keys(props), lambda x: strlen(x) + 1)))::BIGINT AS b FROM events) "
    "SELECT 0::BIGINT AS depth, n AS n_nodes, n AS n_expressions, 0::BIGINT AS n_arguments, 7 * n AS string_bytes, 1::BIGINT AS n_distinct_strings FROM k "
    "UNION ALL SELECT 1, m, m, 0, b, (SELECT count(DISTINCT x) FROM (SELECT unnest(json_keys(props)) AS x FROM events)) FROM k UNION ALL SELECT 2, m, 0, m, 0, 0 FROM k"
)
def tree_profile(spark, d):
    return nav.tree_profile(node_table(_t(spark, d, "events"), "event_id", "props"))


@query("SELECT cast(json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey) AS VARCHAR) AS json FROM nation")
def json_rebuild(spark, d):
    return sinks.rows_as_json(_t(spark, d, "nation"))


@query("SELECT to_json(list(n_name ORDER BY n_nationkey))::VARCHAR AS cells FROM nation")
def column_as_json(spark, d):
    from treeframe.sources.csv import column_json

    return column_json(_t(spark, d, "nation"), "n_name", "n_nationkey")


@query("SELECT 0::BIGINT AS differences")
def structural_equality(spark, d):
    """Nation against itself after a turn through BSON."""
    df = _t(spark, d, "nation")
    return nav.structurally_different(df, bson_roundtrip(spark, d).select(df.columns)).agg(F.count("*").alias("differences"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bson_roundtrip(spark, d):
    import pandas as pd

    df = _t(spark, d, "nation")
    names = df.columns

    def read(batches):
        for b in batches:
            yield pd.DataFrame([bson.decode(bytes(x)) for x in b["bson"]], columns=names)

    return sinks.rows_as_bson(df, "n_nationkey").mapInPandas(read, df.schema)


# spans


@query("SELECT vec_id, embedding[4]::DOUBLE AS x FROM embeddings")
def array_element(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", nav.child("embedding", 3).cast("double").alias("x"))


@query("SELECT vec_id, embedding[3:6]::DOUBLE[] AS xs FROM embeddings")
def array_slice(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", sp.slice_array("embedding", 2, 4).cast("array<double>").alias("xs"))


@query(f"SELECT vec_id, list_transform({_POSITIONS}, lambda i: embedding[i + 1])::DOUBLE[] AS xs FROM embeddings")
def array_gather(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", sp.gather_array("embedding", _POSITIONS).cast("array<double>").alias("xs"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding)::DOUBLE AS val FROM embeddings")
def array_explode_typed(spark, d):
    return sp.explode_typed(_t(spark, d, "embeddings"), "vec_id", "embedding", "double")


@query(
    f"SELECT (p.i - 1)::BIGINT AS position, o.o_orderkey, o.o_totalprice FROM (SELECT unnest({_ROWS}) AS r, generate_subscripts({_ROWS}, 1) AS i) p "
    "JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) o ON o.k = p.r"
)
def gather_rows(spark, d):
    rows = with_row_index(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return sp.gather_rows(rows, sp.index_rows(spark, _ROWS)).select("position", "o_orderkey", "o_totalprice")


@query(
    f"SELECT (p.i - 1)::BIGINT AS position, p.r::BIGINT AS row_index, o.o_totalprice AS value FROM (SELECT unnest({_ROWS}) AS r, generate_subscripts({_ROWS}, 1) AS i) p "
    "JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) o ON o.k = p.r"
)
def gather_pages(spark, d):
    """The same from encoded pages; only those that hold one of the rows are decoded."""
    pages = _stored(spark, pg.encode_column(_t(spark, d, "orders"), "o_totalprice", "o_orderkey", ["DELTA"], 8192))
    return gather_from_pages(pages, "o_totalprice", pg.DOUBLE, sp.index_rows(spark, _ROWS))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k >= 100 AND k < 350")
def subspan(spark, d):
    return sp.subspan(with_row_index(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 100, 250).select("o_orderkey", "o_totalprice")


@query("SELECT conv_id, list(turn ORDER BY turn)::BIGINT[] AS turn FROM conversations GROUP BY conv_id")
def span_by_key(spark, d):
    return sp.collect_span(_t(spark, d, "conversations"), "turn", "turn", "conv_id")


@query("SELECT row_number() OVER (ORDER BY side, k) - 1 AS row_index, value FROM (SELECT 0 AS side, r_regionkey AS k, r_name AS value FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def span_coalesce(spark, d):
    one = lambda t, c, k: with_row_index(_t(spark, d, t), k).select("row_index", F.col(c).alias("value"))
    return en.coalesce_spans(one("region", "r_name", "r_regionkey"), one("nation", "n_name", "n_nationkey"))


# pages


def _stats_sql(table: str, column: str, order: str, size: str, per: int, cast: str) -> str:
    return (
        f"SELECT k // {per} AS page, count(v) AS n_values, min(k) AS first_row_index, {size} AS uncompressed_size, (count(*) - count(v)) AS null_count, count(DISTINCT v) AS distinct_count, min(v) AS min_value, max(v) AS max_value "
        f"FROM (SELECT {column}::{cast} AS v, row_number() OVER (ORDER BY {order}) - 1 AS k FROM {table}) GROUP BY 1"
    )


@query(_stats_sql("orders", "o_custkey", "o_orderkey", "8 * count(v)", 1024, "BIGINT"))
def page_stats_long(spark, d):
    return pg.page_statistics(_t(spark, d, "orders"), "o_custkey", "o_orderkey", 8192)


@query(_stats_sql("lineitem", "l_extendedprice", _LINES, "8 * count(v)", 1024, "DOUBLE"))
def page_stats_double(spark, d):
    return pg.page_statistics(_t(spark, d, "lineitem"), "l_extendedprice", LINE_ORDER, 8192)


_GREEDY = (
    "WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, text AS v, strlen(text) + 4 AS s FROM documents), "
    f"p AS (SELECT k, v, s, 0::BIGINT AS page, s::BIGINT AS used FROM r WHERE k = 0 UNION ALL SELECT r.k, r.v, r.s, CASE WHEN p.used + r.s > {_TEXT_PAGE} THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + r.s > {_TEXT_PAGE} THEN r.s ELSE p.used + r.s END FROM p JOIN r ON r.k = p.k + 1) "
    "SELECT page, count(v) AS n_values, min(k) AS first_row_index, sum(s)::BIGINT AS uncompressed_size, 0::BIGINT AS null_count, count(DISTINCT v) AS distinct_count, min(v) AS min_value, max(v) AS max_value FROM p GROUP BY 1"
)


@query(_GREEDY)
def page_stats_string(spark, d):
    return pg.page_statistics(_t(spark, d, "documents"), "text", "doc_id", _TEXT_PAGE)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, k // 1024 AS page_no, {t} AS physical_type, count(v) AS n_values, min(k) AS first_row_index, 8 * count(v) AS uncompressed_size, (count(*) - count(v)) AS null_count, count(DISTINCT v) AS distinct_count FROM (SELECT {c} AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 2"
        for c, t in (("o_orderkey", 0), ("o_custkey", 0), ("o_totalprice", 1))
    )
)
def page_directory(spark, d):
    return pg.page_directory(_t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey", 8192)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS number_of_values, {size} AS total_uncompressed_size, {t} AS physical_type, 0 AS encoding_type, (max(k) // 1024 + 1) AS n_pages FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)"
        for c, t, size in (("o_orderkey", 0, "8 * count(*)"), ("o_totalprice", 1, "8 * count(*)"))
    )
)
def column_metadata(spark, d):
    pages = pg.encode_table(_t(spark, d, "orders"), {"o_orderkey": ["DELTA", "RLE"], "o_totalprice": ["LZ77"], "nothing": ["RLE"]}, "o_orderkey", 8192)
    return pg.column_metadata(pages).select("column_name", "number_of_values", "total_uncompressed_size", "physical_type", "encoding_type", "n_pages")


@query("SELECT * FROM (SELECT k // 1024 AS page_no, min(v)::BIGINT AS min_long, max(v)::BIGINT AS max_long FROM (SELECT o_custkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1) WHERE max_long >= 3 AND min_long <= 5")
def page_prune_candidates(spark, d):
    pages = _stored(spark, pg.encode_column(_t(spark, d, "orders"), "o_custkey", "o_orderkey", [], 8192))
    return candidates(pages, pg.INT64, 3, 5).select("page_no", "min_long", "max_long")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey AS value FROM orders QUALIFY o_orderkey BETWEEN 500 AND 1200")
def pruned_range_scan(spark, d):
    pages = _stored(spark, pg.encode_column(_t(spark, d, "orders"), "o_orderkey", "o_orderkey", ["DELTA", "RLE"], 8192))
    return range_scan(pages, "o_orderkey", pg.INT64, 500, 1200)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS value FROM customer")
def nullable_column_roundtrip(spark, d):
    """Nulls keep their rows through pages."""
    df = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("bal"))
    return read_column(pg.encode_column(df, "bal", "c_custkey", ["LZ77"], 4096), "bal", pg.DOUBLE)


@query("SELECT 'c_name' AS column_name, count(*) - count(c_name) AS nulls FROM customer UNION ALL SELECT 'c_acctbal', count(*) - count(CASE WHEN c_acctbal >= 0 THEN 1 END) FROM customer")
def null_counts(spark, d):
    c = _t(spark, d, "customer").select("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return ag.null_counts(c, c.columns)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders")
def split_pages(spark, d):
    return pg.split_pages(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000).select("o_orderkey", "page")


# encodings


def _cents(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, c - coalesce(lag(c) OVER (ORDER BY o_orderkey), 0) AS delta FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)")
def delta_values(spark, d):
    return en.delta_values(_cents(spark, d), "cents", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, round(o_totalprice * 100)::BIGINT AS value FROM orders")
def delta_restore(spark, d):
    return en.delta_restore(en.delta_values(_cents(spark, d), "cents", "o_orderkey"))


_RUNS = (
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, o_orderstatus AS v FROM orders), b AS (SELECT *, CASE WHEN k = 0 OR v <> lag(v) OVER (ORDER BY k) THEN 1 ELSE 0 END AS f FROM o), "
    "g AS (SELECT *, sum(f) OVER (ORDER BY k) AS r FROM b), runs AS (SELECT (r - 1)::BIGINT AS run, min(k) AS first_row_index, count(*) AS length, min(v) AS value FROM g GROUP BY r) "
)


@query(_RUNS + "SELECT * FROM runs")
def runs(spark, d):
    return en.runs(_t(spark, d, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderstatus AS value FROM orders")
def runs_restore(spark, d):
    return en.runs_restore(en.runs(_t(spark, d, "orders"), "o_orderstatus", "o_orderkey"))


@query(_RUNS + "SELECT sum(2 * ((length + 254) // 255))::BIGINT AS rle_bytes, count(*) AS n_runs FROM runs")
def rle_size(spark, d):
    return en.rle_size(en.runs(_t(spark, d, "orders"), "o_orderstatus", "o_orderkey"))


@query("SELECT row_number() OVER (ORDER BY v) - 1 AS code, v AS value FROM (SELECT DISTINCT l_shipdate AS v FROM lineitem)")
def dict_build(spark, d):
    return en.dictionary(_t(spark, d, "lineitem"), "l_shipdate")


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def dict_encode(spark, d):
    df = _t(spark, d, "customer")
    return en.dictionary_encode(df, "c_mktsegment", en.dictionary(df, "c_mktsegment")).select("c_custkey", "code")


@query("SELECT c_custkey, c_mktsegment AS value FROM customer")
def dict_decode(spark, d):
    df = _t(spark, d, "customer")
    codes = en.dictionary(df, "c_mktsegment")
    return en.dictionary_decode(en.dictionary_encode(df, "c_mktsegment", codes), "code", codes).select("c_custkey", "value")


@query(
    "SELECT *, (CASE WHEN n_distinct <= 256 THEN 1 WHEN n_distinct <= 65536 THEN 2 ELSE 4 END)::BIGINT AS code_bytes, n_distinct * 2 < n_values AND n_distinct < 255 AS pays FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_returnflag", "l_shipdate", "l_quantity", "l_partkey"))
    + ")"
)
def dict_benefit(spark, d):
    return en.dictionary_benefit(_t(spark, d, "lineitem"), ["l_returnflag", "l_shipdate", "l_quantity", "l_partkey"])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, sum(n * strlen(v))::BIGINT AS total_bytes, sum(strlen(v))::BIGINT AS interned_bytes, sum((n - 1) * strlen(v))::BIGINT AS saved_bytes FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY 1)"
        for c in ("source", "lang", "text")
    )
)
def intern_savings(spark, d):
    return en.intern_savings(_t(spark, d, "documents"), ["source", "lang", "text"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, max({c})::BIGINT AS max_value, length(bin(max({c}))) AS bits FROM part" for c in ("p_size", "p_partkey")))
def bit_width(spark, d):
    return en.bit_width(_t(spark, d, "part"), ["p_size", "p_partkey"])


@query("SELECT k // 8 AS word_no, bit_or((p_size & 255)::BIGINT << (56 - 8 * (k % 8))::INT) AS word, count(*) AS n FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) GROUP BY 1")
def pack_words(spark, d):
    return en.pack_words(_t(spark, d, "part"), "p_size", "p_partkey", 8)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, (p_size - 25)::BIGINT AS value FROM part")
def unpack_words(spark, d):
    """Negative values as well."""
    df = _t(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("v"))
    return en.unpack_words(en.pack_words(df, "v", "p_partkey", 16), 16)


@query(
    "WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'long' ELSE 'string' END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations), "
    "b AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY conv_id ORDER BY o) THEN 0 ELSE 1 END AS f FROM c), g AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY o) AS r FROM b) "
    "SELECT conv_id, 0::BIGINT AS parent_id, min(o) AS first, min(t) AS arg_type, count(*) AS length, count(*) >= 2 AS encoded FROM g GROUP BY conv_id, r"
)
def type_runs(spark, d):
    """Turns as arguments of a conversation: a user's turn stands as its number, another as its text."""
    value = F.when(F.col("role") == "user", F.to_json(F.array("turn"))).otherwise(F.to_json(F.array("text")))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))).alias("a"))
    inner = F.transform("a", lambda x: F.substring(x["v"], F.lit(2), F.length(x["v"]) - 2))
    docs = c.select("conv_id", F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")).alias("j"))
    rows = node_table(docs, "conv_id", "j").where("depth = 1")
    return en.type_runs(rows, "conv_id", least=2)


# codecs: what comes back is the table itself


def _text_roundtrip(steps):
    def run(spark, d):
        pages = pg.encode_column(_t(spark, d, "documents"), "text", "doc_id", steps, _TEXT_PAGE, key="doc_id")
        return read_column(pages, "text", pg.BYTE_ARRAY).select(F.col("key").alias("doc_id"), F.col("value").alias("text"))

    return run


for _name in ("delta", "rle", "lz77", "huffman", "fse", "lzw"):
    QUERIES[f"{_name}_roundtrip"] = _text_roundtrip([_name.upper()])
    ORACLE_SQL[f"{_name}_roundtrip"] = "SELECT doc_id, text FROM documents"
QUERIES["pipeline_roundtrip"] = _text_roundtrip(GENERAL)
ORACLE_SQL["pipeline_roundtrip"] = "SELECT doc_id, text FROM documents"


@query("SELECT doc_id, text FROM documents")
def custom_codec_roundtrip(spark, d):
    """A user's functions in a chain, on a column of rows, without pages."""
    import zlib

    chain = Pipeline.of([(zlib.compress, zlib.decompress), "HUFFMAN"])
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return docs.select("doc_id", chain.decompress_column(chain.compress_column("b")).cast("string").alias("text"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey AS value FROM orders")
def long_pipeline_roundtrip(spark, d):
    return read_column(pg.encode_column(_t(spark, d, "orders"), "o_orderkey", "o_orderkey", GENERAL, _TEXT_PAGE), "o_orderkey", pg.INT64)


@query()
def pipeline_sizes(spark, d):
    return ag.compression_ratio(pg.encode_table(_t(spark, d, "part"), TUNED, "p_partkey", _TEXT_PAGE))


@query()
def size_report(spark, d):
    df = _t(spark, d, "nation")
    return sinks.size_report(df, pg.encode_table(df, {c: GENERAL for c in df.columns}, "n_nationkey"))


from treeframe import queries_files  # noqa: E402, F401  registers its own

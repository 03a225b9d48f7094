"""Queries over documents, sinks, packed buffers, the catalog and the service, and the same in DuckDB's SQL."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid

from pyspark.sql import functions as F

from treeframe.catalog import Catalog
from treeframe.functions import bson
from treeframe.operators import aggregates as ag
from treeframe.operators import encode as en
from treeframe.operators import navigate as nav
from treeframe.operators import pages as pg
from treeframe.operators.order import scratch
from treeframe.plans.pipeline import GENERAL, Builder
from treeframe.plans.scan import read_column
from treeframe.queries import _t, query
from treeframe.service import Server, compress, serialize
from treeframe.sources import build, fixtures, packed, sinks
from treeframe.sources.document import load_document, node_table, plain, rebuild

_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _package(spark, d) -> str:
    """A folder with nation as CSV and a document that names it."""
    folder = f"{scratch(spark)}/package-{uuid.uuid4().hex}"
    _t(spark, d, "nation").coalesce(1).orderBy("n_nationkey").write.csv(f"{folder}/nation.csv", header=True, quote='"', escape='"')
    text = json.dumps({"name": "nations", "resources": [{"path": "nation.csv", "note": "by key"}]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/package.json")
    return folder


# documents


@query(_NATION)
def document_prefix(spark, d):
    """The prefix of CSV files is the document's folder."""
    return load_document(spark, f"{_package(spark, d)}/package.json").table()


@query("SELECT 'nation.csv' AS path, 0::BIGINT AS tables")
def document_without_csv(spark, d):
    """Names of CSV files stay strings."""
    doc = load_document(spark, f"{_package(spark, d)}/package.json", disable_csv=True)
    return spark.createDataFrame([(doc.at("resources[0].path"), len(doc.tables))], "path string, tables long")


@query("SELECT event_id, p.parent_id::BIGINT AS parent_id, 0::BIGINT AS first, p.arg_type AS arg_type, 1::BIGINT AS length, false AS encoded FROM events, (VALUES (NULL, 'expression'), (0, 'expression'), (1, 'long')) p(parent_id, arg_type)")
def type_runs_off(spark, d):
    return en.type_runs(node_table(_t(spark, d, "events"), "event_id", "props"), "event_id", least=1, rle=False)


@query("SELECT * FROM (VALUES ('broken', 'failed to parse'), ('missing', 'failed to read')) t(document, error)")
def document_errors(spark, d):
    folder = f"{scratch(spark)}/broken-{uuid.uuid4().hex}"
    spark.createDataFrame([('{"a": [1, 2',)], "value string").coalesce(1).write.text(f"{folder}/broken")
    rows = []
    for name in ("broken", "missing"):
        try:
            load_document(spark, f"{folder}/{name}")
        except ValueError as e:
            rows.append((name, str(e).partition(":")[0]))
    return spark.createDataFrame(rows, "document string, error string")


def _names(spark, d) -> build.Expression:
    """Names of nations as the arguments of an expression: 25 of them."""
    return build.Head("Table")(build.Head("n_name")(*nav.columns_of(_t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")["n_name"]))


@query("SELECT n_nationkey::BIGINT AS ordinal, n_nationkey + 2::BIGINT AS node_id, 7::BIGINT AS type_id, n_name AS value FROM nation")
def expression_nodes(spark, d):
    """Built, made to rows, cloned and read by type."""
    root = _names(spark, d)
    rows = build.expression_nodes(spark, root)
    again = build.from_nodes(rows.collect()).clone()
    if again != root:
        raise ValueError("the expression isn't the same")
    return spark.createDataFrame([(i, i + 2, build.type_id(v), build.get(v, "string")) for i, v in enumerate(again["n_name"].args)], "ordinal long, node_id long, type_id long, value string")


@query("SELECT 0::BIGINT AS line_no, 'NODE 0 TYPE expression Table' AS line UNION ALL SELECT 1, '  NODE 1 TYPE expression n_name' UNION ALL SELECT n_nationkey + 2, '    NODE ' || (n_nationkey + 2)::VARCHAR || ' TYPE string  ' || n_name FROM nation")
def node_dump(spark, d):
    lines = nav.dump(build.expression_nodes(spark, _names(spark, d))).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def columns_dict(spark, d):
    columns = nav.columns_of(_t(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")
    return spark.createDataFrame(list(zip(*columns.values())), "r_regionkey long, r_name string")


@query("SELECT (2 * count(*))::BIGINT AS in_order, 0::BIGINT AS in_any_order FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS a, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS b FROM nation) WHERE a <> b")
def ordered_equality(spark, d):
    """Nation by its key against itself by region: other rows in most places, but the same ones."""
    df = _t(spark, d, "nation")
    a = nav.different_in_order(df, df, "n_nationkey", ["n_regionkey", "n_nationkey"]).agg(F.count("*").alias("in_order"))
    return a.crossJoin(nav.structurally_different(df, df).agg(F.count("*").alias("in_any_order")))


@query("SELECT 0::BIGINT AS same, (2 * count(*))::BIGINT AS changed FROM events")
def node_equality(spark, d):
    """Trees of events against those of the same texts written anew, and against others in one leaf."""
    df = _t(spark, d, "events").select("event_id", "props")
    own = node_table(df, "event_id", "props")
    again = node_table(df.withColumn("props", F.regexp_replace("props", r"\s+", "")), "event_id", "props")
    other = own.withColumn("long_v", F.when(F.col("long_v").isNotNull(), F.col("long_v") + 1))
    count = lambda x, name: nav.different_nodes(own, x, "event_id").agg(F.count("*").alias(name))
    return count(again, "same").crossJoin(count(other, "changed"))


# sinks


@query(_NATION)
def node_sink(spark, d):
    """The flat form: nodes and tables, written and read; the tree is the same."""
    doc = load_document(spark, f"{_package(spark, d)}/package.json")
    path = f"{scratch(spark)}/flat-{uuid.uuid4().hex}"
    sinks.write_nodes(doc, path)
    if plain(rebuild([tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()])) != plain(doc.root):
        raise ValueError("the tree isn't the same")
    return spark.read.parquet(f"{path}/tables/0")


@query(_NATION)
def document_bson_roundtrip(spark, d):
    doc = bson.decode(sinks.document_bson(load_document(spark, f"{_package(spark, d)}/package.json")))
    columns = doc["resources"][0]["path"]["Table"]
    return spark.createDataFrame(list(zip(*(columns[c] for c in ("n_nationkey", "n_name", "n_regionkey")))), "n_nationkey long, n_name string, n_regionkey long")


@query(f"SELECT c.configuration, n.* FROM ({_NATION}) n, (VALUES ('A'), ('B'), ('C'), ('D')) c(configuration)")
def parquet_configurations(spark, d):
    df = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    path = f"{scratch(spark)}/parquet-{uuid.uuid4().hex}"
    out = None
    for c in sinks.PARQUET:
        sinks.write_parquet(df, f"{path}/{c}", c, ["n_regionkey"])
        own = spark.read.parquet(f"{path}/{c}").select(F.lit(c).alias("configuration"), "*")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "SELECT 'json' AS form, sum(strlen(cast(json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey) AS VARCHAR)) + 1)::BIGINT AS bytes FROM nation UNION ALL "
    "SELECT 'bson', sum(5 + (1 + 12 + 4) + (1 + 7 + 4 + strlen(n_name) + 1) + (1 + 12 + 4))::BIGINT FROM nation UNION ALL SELECT 'flat', sum(8 + 8 + 4 + strlen(n_name))::BIGINT FROM nation"
)
def form_sizes(spark, d):
    """Bytes of rows as JSON and BSON, and of plain pages."""
    df = _t(spark, d, "nation")
    return sinks.size_report(df, pg.encode_table(df, {c: [] for c in df.columns}, "n_nationkey"), "n_nationkey").where("form <> 'compressed'")


@query("SELECT 'p_size' AS column_name, 8 * count(p_size) AS uncompressed, 8 * count(p_size) AS compressed, 1.0::DOUBLE AS ratio FROM part UNION ALL SELECT 'p_name', sum(strlen(p_name) + 4)::BIGINT, sum(strlen(p_name) + 4)::BIGINT, 1.0 FROM part")
def sizes_without_codec(spark, d):
    return ag.compression_ratio(pg.encode_table(_t(spark, d, "part"), {"p_size": ["NONE"], "p_name": []}, "p_partkey", 1 << 16))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_custkey::BIGINT AS value FROM orders")
def built_pipeline_roundtrip(spark, d):
    chain = Builder().add("DELTA").add(bytes, bytes).add("RLE").build()
    return read_column(pg.encode_column(_t(spark, d, "orders"), "o_custkey", "o_orderkey", chain, 1 << 16), "o_custkey", pg.INT64, chain)


# packed buffers


def _packable(spark, d):
    """Columns of every type, with negative numbers, nulls and few or many values."""
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.cast("long").alias("o_orderkey"),
        (k % 2 == 0).alias("even"),
        (k % 200 - 100).cast("tinyint").alias("small"),
        F.when(k % 7 != 0, (k % 60_000 - 30_000).cast("smallint")).alias("medium"),
        (-k).cast("int").alias("negative"),
        (k % 1000 / 8).cast("float").alias("eighth"),
        "o_totalprice",
        "o_orderstatus",
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority") if "o_orderpriority" in o.columns else F.when(k % 5 != 0, F.col("o_orderstatus")).alias("priority"),
    )


def _packable_sql(priority: str) -> str:
    return (
        "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderkey::BIGINT AS o_orderkey, o_orderkey % 2 = 0 AS even, (o_orderkey % 200 - 100)::TINYINT AS small, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 60000 - 30000)::SMALLINT END AS medium, "
        f"(-o_orderkey)::INT AS negative, ((o_orderkey % 1000) / 8.0)::FLOAT AS eighth, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN {priority} END AS priority FROM orders"
    )


@query(_packable_sql("o_orderpriority"))
def packed_roundtrip(spark, d):
    df = _packable(spark, d)
    return packed.unpack_table(packed.pack_table(df, "o_orderkey", dict_numbers=True, span_rows=1000), df.schema)


@query(_packable_sql("o_orderpriority"))
def packed_compressed_roundtrip(spark, d):
    """Named columns as encoded and compressed pages in the buffers."""
    df = _packable(spark, d)
    chains = {"o_orderkey": ["DELTA", "RLE"], "medium": ["LZ77"], "o_totalprice": ["DELTA"], "priority": GENERAL, "eighth": ["NONE"]}
    return packed.unpack_table(packed.pack_table(df, "o_orderkey", pipelines=chains, span_rows=2000), df.schema)


@query("SELECT k // 8 AS word_no, bit_or((c & 255)::BIGINT << (56 - 8 * (k % 8))::INT) AS word, count(*) AS n FROM (SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) GROUP BY 1")
def dict_words(spark, d):
    return en.dictionary_words(_t(spark, d, "customer"), "c_mktsegment", "c_custkey")


# catalog and service


@query("SELECT * FROM (VALUES (0, 'new', false, false, 0), (1, 'attached', true, true, 1), (2, 'again', true, true, 1), (3, 'forced', true, true, 2), (4, 'unloaded', true, false, 2), (5, 'attached', true, true, 3), (6, 'freed', false, false, 3)) t(step, what, there, loaded, loads)")
def catalog_states(spark, d):
    """A name through all its states; a load is only done when it must be."""
    catalog, loads, rows = Catalog(), [], []

    def load():
        loads.append(1)
        return _t(spark, d, "nation")

    def note(what: str) -> None:
        rows.append((len(rows), what, catalog.exists("x"), catalog.is_loaded("x"), len(loads)))

    note("new")
    catalog.attach("x", load)
    note("attached")
    catalog.attach("x", load)
    note("again")
    catalog.attach("x", load, force_reload=True)
    note("forced")
    catalog.unload("x")
    note("unloaded")
    catalog.attach("x", load)
    note("attached")
    if catalog.current.name != "x" or catalog.names() != ["x"] or catalog.size("x") <= 0:
        raise ValueError("the current segment is another one")
    catalog.free("x")
    note("freed")
    return spark.createDataFrame(rows, "step int, what string, there boolean, loaded boolean, loads int")


@query(_NATION)
def service_serialize(spark, d):
    return serialize(spark, "nations", f"{_package(spark, d)}/package.json", catalog=Catalog()).value.table()


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_index, n_name AS value FROM nation")
def service_compress(spark, d):
    """A whole document with pages in the place of a column."""
    report = compress(spark, "nations", f"{_package(spark, d)}/package.json", {"n_name": ["LZ77", "HUFFMAN"], "nothing": ["RLE"]}, catalog=Catalog())
    if report.warnings != ["no column nothing"]:
        raise ValueError(f"unexpected warnings {report.warnings}")
    (pages,) = report.value.pages.values()
    return read_column(pages, "n_name", pg.BYTE_ARRAY)


@query("SELECT * FROM (VALUES (0, 'GET /serialize', 200, true), (1, 'GET /load', 200, true), (2, 'POST /compress', 200, true), (3, 'POST /compress', 400, false), (4, 'GET /nothing', 404, false), (5, 'GET /stop', 200, false)) t(call, route, status, success)")
def service_http(spark, d):
    server = Server(spark).start()
    where = f"name=n&path={_package(spark, d)}/package.json"
    calls = [("GET", f"/serialize?{where}", None), ("GET", f"/load?{where}", None), ("POST", f"/compress?{where}2&disableCsvHandling=true".replace("package.json2", "package.json"), '{"n_name": ["RLE"]}'), ("POST", f"/compress?{where}", "no map"), ("GET", "/nothing", None), ("GET", "/stop", None)]
    rows = []
    for i, (method, url, body) in enumerate(calls):
        request = urllib.request.Request(f"http://127.0.0.1:{server.port}{url}", None if body is None else body.encode(), method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                status, text = r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            status, text = e.code, e.read().decode()
        rows.append((i, f"{method} {url.partition('?')[0]}", status, text.startswith("Success")))
    return spark.createDataFrame(rows, "call int, route string, status int, success boolean")


# inputs that are made


@query("SELECT 'nation' AS name, 'n_nationkey:integer,n_name:string,n_regionkey:integer' AS fields, count(*) AS n FROM nation UNION ALL SELECT 'region', 'r_regionkey:integer,r_name:string,r_size:number', count(*) FROM region")
def nested_metadata(spark, d):
    """From a DDL to a document of two tables, with their files."""
    ddl = "CREATE TABLE NATION (n_nationkey INTEGER NOT NULL, n_name CHAR(25) NOT NULL, n_regionkey INTEGER, PRIMARY KEY (n_nationkey));\nCREATE TABLE REGION (r_regionkey INTEGER, r_name VARCHAR(25), r_size DECIMAL(15,2));"
    folder = f"{scratch(spark)}/metadata-{uuid.uuid4().hex}"
    for t in ("nation", "region"):
        _t(spark, d, t).coalesce(1).write.csv(f"{folder}/{t}.csv", header=True)
    spark.createDataFrame([(json.dumps(fixtures.metadata(ddl, "two tables")),)], "value string").coalesce(1).write.text(f"{folder}/metadata.json")
    doc = load_document(spark, f"{folder}/metadata.json")
    rows = []
    for i in range(2):
        fields = plain(doc.at(f"tables[{i}].schema.fields"))
        rows.append((doc.at(f"tables[{i}].name"), ",".join(f"{f['name']}:{f['type']}" for f in fields), doc.table(f"tables[{i}].file").count()))
    return spark.createDataFrame(rows, "name string, fields string, n long")


@query("SELECT 10000::BIGINT AS n, 10000::BIGINT AS ids, 6::BIGINT AS names, 47::BIGINT AS ages, 2::BIGINT AS genders, 9999::BIGINT AS minutes")
def seeded_frame(spark, d):
    f = fixtures.seeded_frame(spark)
    span = (F.max("join_date").cast("long") - F.min("join_date").cast("long")) / 60
    return f.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("name").alias("names"), F.count_distinct("age").alias("ages"), F.count_distinct("gender").alias("genders"), span.cast("long").alias("minutes"))

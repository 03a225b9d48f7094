import json

import pytest

from treeframe.catalog import Catalog
from treeframe.operators import navigate as nav
from treeframe.operators.pages import BYTE_ARRAY
from treeframe.plans.scan import read_column
from treeframe.service import Server, compress, flag, serialize
from treeframe.sources import build, sinks
from treeframe.sources.csv import column_json, column_types, load_column, load_csv, open_csv
from treeframe.sources.document import Pairs, load_document, node_table, nodes, parse, rebuild
from treeframe.functions import bson


@pytest.fixture
def people(tmp_path):
    (tmp_path / "people.csv").write_text("Name,Age,Height\nAlice,30,165.5\nBob,25,185.5")
    (tmp_path / "doc.json").write_text(json.dumps({"Name": "string", "Age": "int", "data": "people.csv", "other": "people.CSV"}))
    return tmp_path


def test_columns(spark, people):
    raw = open_csv(spark, f"{people}/people.csv")
    assert column_types(raw) == {"Name": "string", "Age": "long", "Height": "double"}
    assert load_column(raw, "Height", "long") is None and load_column(raw, "Name", "double") is None
    assert [r.Age for r in load_column(raw, "Age", "long").collect()] == [30, 25]
    assert nav.columns_of(load_csv(spark, f"{people}/people.csv"), "Name") == {"Name": ["Alice", "Bob"], "Age": [30, 25], "Height": [165.5, 185.5]}
    assert column_json(load_csv(spark, f"{people}/people.csv"), "Age", "Name").first()[0] == "[30,25]"


def test_inference_matrix(spark, tmp_path):
    cells = {"lead": (" 12", "long"), "trail": ("12 ", "string"), "plus": ("+5", "long"), "point": ("5.0", "double"), "exp": ("1e5", "double"), "inf": ("inf", "double"), "nan": ("nan", "double"), "suffix": ("1d", "string"), "wide": ("99999999999999999999", "double"), "empty": ("", "long"), "a, %": ('q,""r""', "string")}
    names = ",".join(f'"{c}"' for c in cells)
    (tmp_path / "m.csv").write_text(names + "\n" + ",".join(f'"{v}"' if "q" in v else v for v, _ in cells.values()) + "\n" + "," * (len(cells) - 1) + "\n")
    raw = open_csv(spark, f"{tmp_path}/m.csv")
    assert column_types(raw) == {c: t for c, (_, t) in cells.items()}
    first, second = load_csv(spark, f"{tmp_path}/m.csv").collect()
    assert first["lead"] == 12 and first["wide"] == 1e20 and first["a, %"] == 'q,"r"' and first["empty"] is None
    assert second["lead"] is None and second["trail"] == "" and second["point"] is None


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b,a\n")
    df = load_csv(spark, f"{tmp_path}/h.csv")
    assert df.dtypes == [("a", "string"), ("b", "string"), ("a_2", "string")] and df.count() == 0
    with pytest.raises(Exception):
        load_csv(spark, f"{tmp_path}/none.csv")


def test_document(spark, people):
    doc = load_document(spark, f"{people}/doc.json")
    assert list(doc.tables) == ["data"] and doc.at("Name") == "string" and doc.at("other") == "people.CSV"
    assert doc.table().count() == 2
    with pytest.raises(KeyError):
        doc.at("nothing")
    assert load_document(spark, f"{people}/doc.json", disable_csv=True).at("data") == "people.csv"
    for bad in ("{", "nofile"):
        (people / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            load_document(spark, f"{people}/bad.json")
    with pytest.raises(ValueError, match="failed to read"):
        load_document(spark, f"{people}/none.json")
    full = {"Name": "string", "Age": "int", "data": {"Table": {"Name": ["Alice", "Bob"], "Age": [30, 25], "Height": [165.5, 185.5]}}, "other": "people.CSV"}
    assert json.loads(sinks.document_json(doc)) == full and bson.decode(sinks.document_bson(doc)) == full
    sinks.write_nodes(doc, f"{people}/out")
    assert spark.read.parquet(f"{people}/out/nodes").count() == doc.node_table().count()


@pytest.mark.parametrize("text", ['{"a":1,"a":[{},[],null,true,2.5,"x"],"big":99999999999999999999}', "[]", "3", '{"Object":{"Object":1},"List":[[1]]}', '{"x":{"y":{"z":"end"}}}'])
def test_nodes_round_trip(text):
    tree = parse(text)
    assert rebuild(list(nodes(tree))) == tree


def test_node_table(spark):
    df = spark.createDataFrame([(1, '{"k":5,"t":[1,"x",null]}'), (2, None), (3, "[]")], "id long, j string")
    rows = node_table(df, "id", "j")
    assert {(r.id, r.arg_type, r.n) for r in rows.groupBy("id", "arg_type").agg({"*": "count"}).toDF("id", "arg_type", "n").collect()} == {(1, "expression", 4), (1, "long", 2), (1, "string", 1), (1, "symbol", 1), (3, "expression", 1)}
    assert isinstance(parse('{"a":1}'), Pairs)
    assert "TYPE long" in nav.dump(rows.where("id = 1"))


def test_lookup(spark):
    df = spark.createDataFrame([('{"a":[{"b":7}]}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(nav.lookup("j", "$.a[0].b", "bigint")).collect()] == [7, None, None]
    with pytest.raises(Exception, match="not found"):
        df.limit(1).select(nav.lookup("j", "$.zz", "bigint", strict=True)).collect()


def test_expressions(spark):
    h = build.Head("Add")
    e = h(1, 2.5, "x", build.Symbol("x"), True, build.Head("Inner")(3))
    assert e == e.clone() and e != h(1, 2.5, "x", "x", True, build.Head("Inner")(3))
    assert h(1) != h(True) and h(1) != h(1.0)
    assert e["Inner"][0] == 3 and build.type_id(e) == 9 and build.get_if(1, "string") is None
    with pytest.raises(KeyError):
        e["Outer"]
    with pytest.raises(TypeError, match="expected string, found long"):
        build.get(1, "string")
    assert build.from_nodes(build.expression_nodes(spark, e).collect()) == e


def test_catalog_and_service(spark, people):
    catalog = Catalog()
    first = serialize(spark, "people", f"{people}/doc.json", catalog=catalog).value
    assert serialize(spark, "people", "no such file", catalog=catalog).value is first
    assert catalog.is_loaded("people") and catalog.names() == ["people"] and catalog.size("people") > 0
    catalog.cache("people")
    catalog.unload("people")
    assert catalog.exists("people") and not catalog.is_loaded("people")
    catalog.unload("people")
    catalog.free("people")
    catalog.free("people")
    assert not catalog.exists("people") and catalog.current is None
    report = compress(spark, "c", f"{people}/doc.json", {"Name": ["LZ77", "HUFFMAN"], "data/Age": ["DELTA"], "none": ["RLE"]}, catalog=catalog)
    assert report.warnings == ["no column none"] and "Success" in str(report)
    pages = report.value.pages["data"]
    assert [r.value for r in read_column(pages, "Name", BYTE_ARRAY).orderBy("row_index").collect()] == ["Alice", "Bob"]
    assert [flag(x) for x in ("", "true", "True", "2", "0", "no", None, True)] == [True, True, True, True, False, False, False, True]


def test_server(spark, people):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    server = Server(spark).start()
    at = f"http://127.0.0.1:{server.port}"
    assert b"Success" in urlopen(f"{at}/serialize?name=a&path={people}/doc.json&disableCsvHandling=").read()
    assert b"Success" in urlopen(Request(f"{at}/compress?name=b&path={people}/doc.json", data=b'{"Age":["RLE"]}')).read()
    with pytest.raises(HTTPError):
        urlopen(Request(f"{at}/compress?name=c&path={people}/doc.json", data=b"no json"))
    assert urlopen(f"{at}/stop").read() == b"stopping"


def test_sizes(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('name', id % 7) AS name")
    assert [r.configuration for r in sinks.parquet_report(df, str(tmp_path)).where("bytes > 0").collect()] == ["A", "B", "C", "D"]
    sinks.write_bytes(b"abc", f"{tmp_path}/x/y.bin")
    assert (tmp_path / "x/y.bin").read_bytes() == b"abc"

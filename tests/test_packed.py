import numpy as np
import pytest

from treeframe.sources.build import Expression, Head, Symbol
from treeframe.sources.fixtures import metadata
from treeframe.sources.packed import Reader, Span, pack, pack_fields, pack_table, unpack_fields, unpack_table


def flat(e):
    """An expression with spans as single arguments and their type."""
    out = []
    for a in e.args:
        if isinstance(a, Span):
            out += [(a.kind, v.item() if hasattr(v, "item") else v) for v in a.values]
        else:
            kind = "symbol" if isinstance(a, Symbol) else {bool: "bool", int: "long", float: "double", str: "string"}.get(type(a))
            out.append(flat(a) if isinstance(a, Expression) else (kind, bool(a) if kind == "bool" else a))
    return (e.head, [(k, bool(v)) if k == "bool" else (k, v) for k, v in out if k is not None] if not any(isinstance(a, Expression) for a in e.args) else out)


@pytest.mark.parametrize("bits,dtype", [(8, "i1"), (16, "<i2"), (32, "<i4"), (32, "<f4"), (8, "u1")])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_fields(bits, dtype, n):
    v = np.random.default_rng(n).integers(-120, 120, n).astype(dtype)
    words = pack_fields(v, bits)
    assert len(words) == -(-n * bits // 64) and np.array_equal(unpack_fields(words, bits, n, dtype), v)


def test_first_value_in_the_highest_field():
    assert pack_fields(np.array([-1, 2], np.int8), 8).tolist() == [0xFF02 << 48]
    assert pack_fields(np.array([1, -2, 3], np.int16), 16).tolist() == [0x0001FFFE00030000]


@pytest.mark.parametrize("strings,numbers", [(True, False), (True, True), (False, False)])
def test_expressions(strings, numbers):
    e = Head
    trees = [
        e("Nothing")(),
        e("One")(1),
        e("All")(True, False, 1, 2, -3, 1.5, "a", "a", Symbol("a"), e("In")("b", e("Deep")(float("inf")), 4), "c", False),
        e("Long")(*range(40), *[0.5] * 30, *["x", "y"] * 20, *[Symbol("s")] * 14, *[e("E")(i) for i in range(15)]),
        e("Many")(*[7] * 300, *[f"v{i % 100}" for i in range(400)], *[f"w{i}" for i in range(300)]),
        e("Spans")(Span("char", [-1, 127, -128]), Span("short", [-5, 300]), Span("int", [-7] * 20), Span("float", [0.25, -1.0, 3.5]), Span("bytes", [b"", b"\0\xff"]), "end", Span("bool", [True] * 9), Span("long", [])),
    ]
    for t in trees:
        back = Reader(pack(t, strings, numbers)).expression()
        assert flat(back) == flat(t), t


def test_dictionaries_runs_and_the_heap_pay():
    many = Head("T")(*["one of a few"] * 5000)
    assert len(pack(many)) < 5300 < 8 * 5000 < len(pack(many, dict_strings=False))
    assert [(k, n) for k, n, *_ in Reader(pack(Head("T")(*range(13)))).runs()] == [("expression", 1), ("long", 13)]
    with pytest.raises(ValueError):
        Reader(b"\0" * 40)
    with pytest.raises(ValueError):
        Reader(pack(many)[:-1])


def test_tables(spark):
    rows = [(i, i % 2 == 0, i % 250 - 125, None if i % 3 else i / 8, None if i % 4 else f"s{i % 5}", -i, "" if i % 2 else "é") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, b boolean, t byte, f float, s string, n int, e string").repartition(3)
    for given in ({}, {"dict_numbers": True}, {"span_rows": 7}, {"pipelines": {"k": ["DELTA"], "s": ["LZ77"], "f": [], "b": ["RLE"], "missing": ["RLE"]}}):
        packed = pack_table(df, "k", **({"span_rows": 64} | given))
        assert sorted(tuple(r)[1:] for r in unpack_table(packed, df.schema).collect()) == rows
    some = unpack_table(pack_table(df, "k", ["s", "t"]), df.schema, ["t"])
    assert some.columns == ["row_index", "t"] and some.count() == 500
    assert unpack_table(pack_table(df.limit(0), "k"), df.schema).count() == 0
    with pytest.raises(TypeError):
        pack_table(df.selectExpr("k", "array(1) AS a"), "k")


def test_metadata():
    m = metadata("create table A (x INT, y DECIMAL(15,2) NOT NULL, z VARCHAR(3), PRIMARY KEY (x, y)); CREATE TABLE b(\n d DATE\n);", "n", {"a": "first"})
    assert [(t["name"], t["file"], t["description"], [(f["name"], f["type"]) for f in t["schema"]["fields"]]) for t in m["tables"]] == [
        ("a", "a.csv", "first", [("x", "integer"), ("y", "number"), ("z", "string")]),
        ("b", "b.csv", "", [("d", "string")]),
    ]

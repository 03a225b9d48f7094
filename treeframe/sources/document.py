"""JSON documents whose strings may name CSV files: trees on the driver, tables as lazy frames.

A document is small, its tables need not be. Objects keep the order of their keys and keys that come
twice. Every string that ends in .csv becomes a table, read by sources.csv.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from treeframe.sources.csv import load_csv


class Pairs(list):
    """A JSON object: (key, value) in order."""

    def get(self, key: str) -> Any:
        for k, v in self:
            if k == key:
                return v
        raise KeyError(f"{key} not found")


@dataclass(frozen=True)
class Table:
    """In the place of a string that names a CSV file."""

    path: str


NODE_SCHEMA = "node_id long, parent_id long, ordinal long, depth long, head string, arg_type string, long_v long, double_v double, string_v string"


#: made once: json.loads would make one for each text
_DECODER = json.JSONDecoder(object_pairs_hook=Pairs)


def parse(text: str) -> Any:
    try:
        return _DECODER.decode(text)
    except ValueError as e:
        raise ValueError(f"failed to parse: {e}") from e


def is_csv(value: Any) -> bool:
    """What follows the last dot is exactly csv."""
    return isinstance(value, str) and "." in value and value.rpartition(".")[2] == "csv"


def nodes(tree: Any) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA, layer by layer; the children of a node are numbered from 0.

    An object is a node Object, each key a node of its name with one child; an array is a node List;
    null, true and false are symbols.
    """
    layer: list[tuple[int | None, int, str | None, Any]] = [(None, 0, None, tree)]
    n, depth = 0, 0
    while layer:
        below: list[tuple[int | None, int, str | None, Any]] = []
        for parent, ordinal, key, v in layer:
            me = n
            n += 1
            head = long_v = double_v = string_v = None
            kind = "expression"
            if key is not None:
                head = key
                below.append((me, 0, None, v))
            elif isinstance(v, Pairs):
                head = "Object"
                below += [(me, i, k, x) for i, (k, x) in enumerate(v)]
            elif isinstance(v, list):
                head = "List"
                below += [(me, i, None, x) for i, x in enumerate(v)]
            elif isinstance(v, Table):
                head, string_v = "Table", v.path
            elif v is None or isinstance(v, bool):
                kind, string_v = "symbol", {None: "Null", True: "True", False: "False"}[v]
            elif isinstance(v, int):
                # beyond 64 bits: digits are kept as text
                if -(1 << 63) <= v < 1 << 63:
                    kind, long_v = "long", v
                else:
                    kind, string_v = "decimal", str(v)
            elif isinstance(v, float):
                kind, double_v = "double", v
            else:
                kind, string_v = "string", v
            yield me, parent, ordinal, depth, head, kind, long_v, double_v, string_v
        layer, depth = below, depth + 1


def rebuild(rows: list[tuple]) -> Any:
    """The tree of rows of NODE_SCHEMA."""
    children: dict[int | None, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2])):
        children.setdefault(r[1], []).append(r)

    def value(r: tuple) -> Any:
        node, head, kind = r[0], r[4], r[5]
        own = children.get(node, [])
        if kind == "expression":
            if head == "Table" and r[8] is not None:
                return Table(r[8])
            if r[1] is not None and parent_head.get(r[1]) == "Object":
                return (head, value(own[0]))
            return Pairs(value(c) for c in own) if head == "Object" else [value(c) for c in own]
        if kind == "symbol":
            return {"Null": None, "True": True, "False": False}[r[8]]
        return {"long": r[6], "double": r[7], "string": r[8]}.get(kind) if kind != "decimal" else int(r[8])

    # a node named Object below an Object is a key, unless it is that key's value
    parent_head: dict[int, str] = {}
    by_id = {r[0]: r for r in rows}
    for r in sorted(rows):
        above = by_id.get(r[1])
        is_key = above is not None and parent_head.get(above[0]) == "Object"
        parent_head[r[0]] = "Key" if is_key else (r[4] if r[5] == "expression" else "Leaf")
    (root,) = children[None]
    return value(root)


def plain(tree: Any) -> Any:
    """Dictionaries and lists; of keys that come twice the last counts."""
    if isinstance(tree, Pairs):
        return {k: plain(v) for k, v in tree}
    if isinstance(tree, list):
        return [plain(v) for v in tree]
    return tree.path if isinstance(tree, Table) else tree


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


@dataclass
class Document:
    """A tree, and the frames of its tables by path, such as resources[0].path."""

    spark: SparkSession
    root: Any
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def at(self, path: str) -> Any:
        """The value at keys and positions, such as resources[0].path; raises where there is none."""
        v = self.root
        for key, index in _STEP.findall(path):
            if key:
                if not isinstance(v, Pairs):
                    raise KeyError(f"{key} not found")
                v = v.get(key)
            else:
                v = v[int(index)]
        return v

    def table(self, path: str | None = None) -> DataFrame:
        """The frame of the table there; without a path, of the only one."""
        if path is None:
            (path,) = self.tables
        return self.tables[path]

    def node_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(nodes(self.root)), NODE_SCHEMA)


def _substitute(spark: SparkSession, v: Any, prefix: str, path: str, tables: dict[str, DataFrame]) -> Any:
    if isinstance(v, Pairs):
        return Pairs((k, _substitute(spark, x, prefix, f"{path}.{k}" if path else k, tables)) for k, x in v)
    if isinstance(v, list):
        return [_substitute(spark, x, prefix, f"{path}[{i}]", tables) for i, x in enumerate(v)]
    if is_csv(v):
        tables[path] = load_csv(spark, prefix + v)
        return Table(prefix + v)
    return v


def load_document(spark: SparkSession, path: str, csv_prefix: str | None = None, disable_csv: bool = False) -> Document:
    """Reads a JSON document. csv_prefix: before the names of CSV files; by default the document's folder."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        raise ValueError(f"failed to read: {path}") from e
    if not rows:
        raise ValueError(f"failed to read: {path}")
    root = parse(rows[0][0])
    prefix = path[: max(path.rfind("/"), path.rfind("\\")) + 1] if csv_prefix is None else csv_prefix
    tables: dict[str, DataFrame] = {}
    return Document(spark, root if disable_csv else _substitute(spark, root, prefix, "", tables), tables)


#: rows of a batch of nodes, more where one document has more
_NODES = 1 << 14


def _children_of(head: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Parents come before their children."""
    parents = set()
    for r in rows:
        if r[4] == head and r[5] == "expression":
            parents.add(r[0])
        if r[1] in parents:
            yield r


def node_table(df: DataFrame, key: str, text: str, children_of: str | None = None) -> DataFrame:
    """Nodes of a column of JSON texts: key and NODE_SCHEMA. A null text has none; a wrong one raises.

    children_of: only the children of nodes of that head, each text by itself, without a join.
    """
    kind = df.schema[key].dataType.simpleString()
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(NODE_SCHEMA))]
    names = [key, *(c.split()[0] for c in NODE_SCHEMA.split(", "))]

    def made(keys: pa.Array, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is not None:
                    own = nodes(parse(t))
                    rows += own if children_of is None else _children_of(children_of, own)
                    places += [i] * (len(rows) - len(places))
                if len(rows) >= _NODES:
                    yield made(batch.column(0), places, rows)
                    places, rows = [], []
            yield made(batch.column(0), places, rows)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {NODE_SCHEMA}")


def variant(df: DataFrame, text: str, name: str = "v") -> DataFrame:
    """The column of JSON texts, parsed for navigation inside Spark."""
    return df.withColumn(name, F.try_parse_json(F.col(text)))

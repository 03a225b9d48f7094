"""Navigation in documents: by key, position, path and type, on JSON text, VARIANT or node rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeframe.operators.order import with_row_index

def lookup(json: Column | str, path: str, kind: str = "string", strict: bool = False) -> Column:
    """The value at a path such as $.resources[0].path, as a type; null, or an error if strict, where there is none.

    Where keys come twice the parser keeps one; node rows keep both.
    """
    c = F.col(json) if isinstance(json, str) else json
    if strict:
        # a value of another type raises as well
        v = F.variant_get(F.parse_json(c), path, kind)
        return F.coalesce(v, F.raise_error(F.lit(f"{path} not found")).cast(kind))
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def child(array: Column | str, position: int) -> Column:
    """The element at a position from 0; null where there is none."""
    return F.try_element_at(F.col(array) if isinstance(array, str) else array, F.lit(position + 1))


def type_of(json: Column | str, path: str = "$") -> Column:
    """The type of a value, in capitals, as Spark names it; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(json) if isinstance(json, str) else json), path, "variant"))


def typed_cells(rows: DataFrame, kind: str) -> DataFrame:
    """Of node rows, those whose argument has the type."""
    return rows.where(F.col("arg_type") == kind)


def children(rows: DataFrame, key: str, head: str) -> DataFrame:
    """Of node rows with a document key: the children of every node of that head. Of texts, node_table finds them without the join."""
    parents = rows.where((F.col("head") == head) & (F.col("arg_type") == "expression")).select(F.col(key).alias("tf_key"), F.col("node_id").alias("tf_node"))
    return rows.join(parents, (F.col(key) == F.col("tf_key")) & (F.col("parent_id") == F.col("tf_node"))).drop("tf_key", "tf_node")


def first_child_with_head(rows: DataFrame, key: str, head: str) -> DataFrame:
    """Of each document, the first child of the root whose head it is: key and node_id."""
    return rows.where((F.col("depth") == 1) & (F.col("head") == head)).groupBy(key).agg(F.min_by("node_id", "ordinal").alias("node_id"))


def structurally_different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other hasn't, as often as they come; empty if the two are equal.

    Types and names of the columns must be the same, in order. Rows in another order are the same here;
    see different_in_order, and for trees different_nodes.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise TypeError("the schemas differ")
    names = [f"tf_{i}" for i in range(len(a.columns))]
    # each table is made and shuffled once: how often a row comes in the one less how often in the other
    both = a.toDF(*names).withColumn("tf_n", F.lit(1)).unionAll(b.toDF(*names).withColumn("tf_n", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("tf_n").alias("tf_n")).where("tf_n <> 0")
    side = F.when(F.col("tf_n") > 0, "left").otherwise("right")
    return left.select(*names, side.alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("tf_n")))).drop("col").toDF(*a.columns, "side")


def different_in_order(a: DataFrame, b: DataFrame, order_by: str | list[str], other_order: str | list[str] | None = None) -> DataFrame:
    """row_index, side and the columns of rows that differ from those of the same number in the other frame."""
    one, two = with_row_index(a, order_by), with_row_index(b, order_by if other_order is None else other_order)
    columns = ["row_index", *a.columns]
    return structurally_different(one.select(columns), two.select("row_index", *b.columns))


def different_nodes(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Of two tables of node rows (and the keys of their documents): the nodes that aren't the same in place, head, type and value.

    Nodes are numbered layer by layer, so that two trees are equal, children in order, if none differs.
    """
    columns = [*keys, "node_id", "parent_id", "ordinal", "head", "arg_type", "long_v", "double_v", "string_v"]
    return structurally_different(a.select(columns), b.select(columns))


def equal(a: DataFrame, b: DataFrame, order_by: str | list[str] | None = None) -> bool:
    """Of tables; with an order, rows must also come in the same one."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        return False
    return (structurally_different(a, b) if order_by is None else different_in_order(a, b, order_by)).isEmpty()


def columns_of(df: DataFrame, order_by: str) -> dict[str, list]:
    """A small table as a dictionary of columns."""
    rows = df.orderBy(order_by).collect()
    return {c: [r[c] for r in rows] for c in df.columns}


def tree_profile(rows: DataFrame, *keys: str) -> DataFrame:
    """By layer: nodes, arguments, expressions, bytes of strings and heads, and these with equal ones once."""
    text = F.coalesce("string_v", "head")
    return rows.groupBy(*keys, "depth").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("arg_type") == "expression").alias("n_expressions"),
        F.count_if(F.col("arg_type") != "expression").alias("n_arguments"),
        F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).alias("string_bytes"),
        F.count_distinct(text).alias("n_distinct_strings"),
    )


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arg_type").agg(F.count("*").alias("n"))


def dump(rows: DataFrame) -> str:
    """A small tree as text, a line a node."""
    out = []
    for r in rows.orderBy("node_id").collect():
        value = next((v for v in (r.long_v, r.double_v, r.string_v) if v is not None), "")
        out.append(f"{'  ' * r.depth}NODE {r.node_id} TYPE {r.arg_type} {r.head or ''} {value}".rstrip())
    return "\n".join(out)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

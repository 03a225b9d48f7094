"""CSV scans with the types that the cells themselves have: long, double or string, by column, from all rows."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: whole numbers and floating-point numbers as a C library reads them, with blanks before but not after
INT = r"^\s*[+-]?[0-9]+$"
DOUBLE = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n.lower()] = seen.get(n.lower(), 0) + 1
        out.append(n if k == 1 else f"{n}_{k}")
    return out


def open_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text. Row 0 is the header; a name that comes again gets a number.

    Comma, double quotes, doubled inside quotes; no trimming, comments or line breaks in cells. Blank
    lines are skipped. A file that can't be read raises.
    """
    first = spark.read.text(path).limit(1).collect()
    names = _unique(next(csv.reader([first[0][0]]))) if first else []
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    if not names:
        return spark.createDataFrame([], "value string").select()
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)


def as_long(cell: Column) -> Column:
    """The cell as a whole number; null where it is none, or too large."""
    return F.when(cell.rlike(INT), F.trim(cell).try_cast("bigint"))


def as_double(cell: Column) -> Column:
    return F.when(cell.rlike(DOUBLE), F.trim(cell).try_cast("double"))


def _blank(cell: Column) -> Column:
    return cell.isNull() | (cell == "")


def column_types(df: DataFrame) -> dict[str, str]:
    """long, double or string of each text column: the first that every cell with something in it has.

    One pass over the rows for all columns. A column of empty cells is long; without rows, string.
    """
    if not df.columns:
        return {}
    checks = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        cell = F.col(quoted(c))
        checks += [
            F.coalesce(F.bool_and(_blank(cell) | as_long(cell).isNotNull()), F.lit(True)).alias(f"l{i}"),
            F.coalesce(F.bool_and(_blank(cell) | as_double(cell).isNotNull()), F.lit(True)).alias(f"d{i}"),
        ]
    row = df.agg(*checks).first()
    if not row["n"]:
        return {c: "string" for c in df.columns}
    return {c: "long" if row[f"l{i}"] else "double" if row[f"d{i}"] else "string" for i, c in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns as their types. An empty cell is null in a numeric column and '' in one of strings."""
    types = column_types(df) if types is None else types
    how = {"long": as_long, "double": as_double, "string": lambda c: F.coalesce(c, F.lit(""))}
    return df.select([how[types[c]](F.col(quoted(c))).alias(c) for c in df.columns])


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed(open_csv(spark, path))


def load_column(df: DataFrame, column: str, kind: str) -> DataFrame | None:
    """One text column as `kind`; None where some cell isn't of it."""
    order = ("long", "double", "string")
    if kind not in order:
        raise ValueError(f"a column is one of {order}")
    one = df.select(quoted(column))
    if kind != "string":
        found = column_types(one)[one.columns[0]]
        if order.index(found) > order.index(kind):
            return None
    return typed(one, {one.columns[0]: kind})


def column_json(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """One row: the column's cells as a JSON array, in the order of another column."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(quoted(order_by)).alias("o"), F.col(quoted(column)).alias("v"))))
    return df.agg(F.to_json(F.transform(cells, lambda x: x["v"]), {"ignoreNullFields": "false"}).alias("cells"))

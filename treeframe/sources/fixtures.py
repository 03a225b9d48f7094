"""Inputs that are made: nested metadata of tables from their DDL, and a frame of random rows."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: of SQL types, those of the metadata; all others are strings
JSON_TYPES = {"INTEGER": "integer", "INT": "integer", "BIGINT": "integer", "SMALLINT": "integer", "DECIMAL": "number", "NUMERIC": "number", "DOUBLE": "number", "FLOAT": "number", "REAL": "number"}
_TABLE = re.compile(r"\bCREATE\s+TABLE\s+(\w+)\s*\(", re.IGNORECASE)
_KEYWORDS = ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY")


def _inside(text: str, start: int) -> list[str]:
    """What stands between a parenthesis and its partner, by commas that are in no other."""
    parts, depth, begin = [], 1, start
    for i in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0 or (depth == 1 and text[i] == ","):
            parts.append(text[begin:i].strip())
            begin = i + 1
        if depth == 0:
            return parts
    raise ValueError("a table has no end")


def metadata(ddl: str, name: str, descriptions: dict[str, str] | None = None) -> dict[str, Any]:
    """A document that names a CSV file for each table of the DDL, with the names and types of its columns."""
    tables = []
    for m in _TABLE.finditer(ddl):
        fields = []
        for words in (part.split() for part in _inside(ddl, m.end()) if part):
            if words[0].upper() in _KEYWORDS or len(words) < 2:
                continue
            fields.append({"name": words[0], "type": JSON_TYPES.get(words[1].partition("(")[0].upper(), "string")})
        table = m[1].lower()
        tables.append({"name": table, "file": f"{table}.csv", "description": (descriptions or {}).get(table, ""), "schema": {"fields": fields}})
    return {"name": name, "title": name, "tables": tables}


def seeded_frame(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """id, name, age, gender, salary, join_date: a row a minute, with values that the seed fixes."""
    rng = np.random.default_rng(seed)
    people = np.array(["Alice", "Bob", "Carol", "Dave", "Eve", "Frank"])
    frame = pd.DataFrame(
        {
            "id": np.arange(rows),
            "name": people[rng.integers(0, len(people), rows)],
            "age": rng.integers(18, 65, rows),
            "gender": np.where(rng.random(rows) < 0.5, "M", "F"),
            "salary": rng.normal(60, 10, rows).round(2),
            "join_date": pd.Timestamp("2010-01-01") + pd.to_timedelta(np.arange(rows), "min"),
        }
    )
    return spark.createDataFrame(frame, "id long, name string, age long, gender string, salary double, join_date timestamp")

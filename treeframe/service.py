"""The calls of the service, as functions and over HTTP."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from treeframe.catalog import CATALOG, Catalog
from treeframe.operators.order import with_row_index
from treeframe.operators.pages import encode_rows, physical_type
from treeframe.plans.pipeline import Pipeline, parse_pipelines
from treeframe.sources.csv import quoted
from treeframe.sources.document import Document, load_document


@dataclass
class Report:
    """A result, how long it took, and warnings."""

    value: Any
    seconds: float
    warnings: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        return f"Success: {self.seconds:.3f} s" + "".join(f"\nwarning: {w}" for w in self.warnings)


def flag(value: str | bool | int | None) -> bool:
    """True for '', true in any case, and numbers above 0."""
    if isinstance(value, str):
        return value == "" or value.lower() == "true" or (value.isdigit() and int(value) > 0)
    return bool(value)


@dataclass
class CompressedDocument:
    """A document, and the pages of its columns that have a pipeline, by the path of their table."""

    document: Document
    pages: dict[str, DataFrame]


def serialize(spark: SparkSession, name: str, path: str, disable_csv: bool = False, force_reload: bool = False, catalog: Catalog = CATALOG) -> Report:
    began = time.perf_counter()
    value = catalog.attach(name, lambda: load_document(spark, path, disable_csv=disable_csv), force_reload)
    return Report(value, time.perf_counter() - began)


def compress_document(document: Document, pipelines: dict[str, Pipeline]) -> tuple[CompressedDocument, list[str]]:
    """Columns are named alone, for all tables, or with the path of their table before: resources[0].path/Year."""
    pages: dict[str, DataFrame] = {}
    used: set[str] = set()
    for path, df in document.tables.items():
        # rows of a file have its order
        from pyspark.sql import functions as F

        rows = with_row_index(df.withColumn("tf_line", F.monotonically_increasing_id()), "tf_line")
        for column in df.columns:
            key = f"{path}/{column}" if f"{path}/{column}" in pipelines else column
            if key not in pipelines:
                continue
            used.add(key)
            kind = physical_type(df, column)
            own = encode_rows(rows.select("row_index", F.col(quoted(column)).alias("value")), column, kind, pipelines[key])
            pages[path] = pages[path].unionByName(own) if path in pages else own
    return CompressedDocument(document, pages), [f"no column {k}" for k in pipelines if k not in used]


def compress(spark: SparkSession, name: str, path: str, body: str | dict, disable_csv: bool = False, force_reload: bool = False, catalog: Catalog = CATALOG) -> Report:
    """body: {column: [codec, ...]}."""
    began = time.perf_counter()
    pipelines = parse_pipelines(body)
    warnings: list[str] = []

    def load() -> CompressedDocument:
        value, said = compress_document(load_document(spark, path, disable_csv=disable_csv), pipelines)
        warnings.extend(said)
        return value

    value = catalog.attach(name, load, force_reload)
    return Report(value, time.perf_counter() - began, warnings)


class Server:
    """GET /serialize and /load, POST /compress, GET /stop."""

    def __init__(self, spark: SparkSession, host: str = "127.0.0.1", port: int = 0, catalog: Catalog | None = None):
        own = self
        self.catalog = Catalog() if catalog is None else catalog

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_: Any) -> None:
                pass

            def answer(self, status: int, text: str) -> None:
                raw = text.encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def run(self, body: str | None) -> None:
                url = urlparse(self.path)
                p = {k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                try:
                    options = {"disable_csv": flag(p["disableCsvHandling"]) if "disableCsvHandling" in p else False, "catalog": own.catalog}
                    if body is None and url.path in ("/serialize", "/load"):
                        self.answer(200, str(serialize(spark, p["name"], p["path"], **options)))
                    elif body is not None and url.path == "/compress":
                        self.answer(200, str(compress(spark, p["name"], p["path"], body, **options)))
                    elif body is None and url.path == "/stop":
                        self.answer(200, "stopping")
                        threading.Thread(target=own.stop).start()
                    else:
                        self.answer(404, "not found")
                except (ValueError, KeyError, TypeError) as e:
                    self.answer(400, f"Error: {e}")

            def do_GET(self) -> None:
                self.run(None)

            def do_POST(self) -> None:
                self.run(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode())

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.port = self.http.server_address[1]

    def start(self) -> Server:
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()


def body_of(pipelines: dict[str, list[str]]) -> str:
    return json.dumps(pipelines)

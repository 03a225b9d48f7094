"""Chains of codecs, by name or as functions of the user, and the presets."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from treeframe.functions import jvm
from treeframe.functions.codecs import CODECS, codec_name

log = logging.getLogger(__name__)
Step = str | tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]


def _in_python(f: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(bytes(v)))

    return run


@dataclass(frozen=True)
class Pipeline:
    """Steps in the order of compression. skip_if_larger: a page leaves out a named step that doesn't shrink it."""

    steps: tuple[Step, ...] = ()
    skip_if_larger: bool = False

    @classmethod
    def of(cls, steps: Sequence[Step] | Pipeline, skip_if_larger: bool = False) -> Pipeline:
        if isinstance(steps, Pipeline):
            return steps
        return cls(tuple(codec_name(s) if isinstance(s, str) else s for s in steps), skip_if_larger)

    @property
    def names(self) -> list[str]:
        return [s if isinstance(s, str) else "CUSTOM" for s in self.steps]

    @property
    def fixed(self) -> bool:
        """Every page takes every step, and all are by name, so that the JVM can take them."""
        return not self.skip_if_larger and all(isinstance(s, str) for s in self.steps)

    def _pair(self, step: Step) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
        return CODECS[step] if isinstance(step, str) else step

    def compress_page(self, data: bytes) -> tuple[bytes, list[str]]:
        """The page, and the steps that it took; a step that more than doubles it is reported."""
        taken = []
        for step, name in zip(self.steps, self.names):
            out = self._pair(step)[0](data)
            if len(out) > 2 * len(data) > 0:
                log.info("step %s more than doubled %d bytes", name, len(data))
            if self.skip_if_larger and len(out) >= len(data) > 0 and name != "CUSTOM":
                continue
            data = out
            taken.append(name)
        return data, taken

    def compress(self, data: bytes) -> bytes:
        if self.skip_if_larger:
            raise ValueError("a chain that skips steps needs compress_page, which says what was skipped")
        return self.compress_page(data)[0]

    def decompress(self, data: bytes, order: Sequence[Step] | None = None) -> bytes:
        """The steps backwards, or in an order given."""
        for step in reversed(self.steps) if order is None else Pipeline.of(order).steps:
            data = self._pair(step)[1](data)
        return data

    def _hops(self, spark: SparkSession | None) -> list[Pipeline]:
        """The chain in parts that stay in the JVM, which are fixed, and parts for Python."""
        if spark is None or self.skip_if_larger or not jvm.available(spark):
            return [self]
        return [Pipeline(tuple(steps)) for _, steps in groupby(self.steps, lambda s: isinstance(s, str))]

    def compress_column(self, column: Column | str) -> Column:
        """The whole chain on a binary column; functions that follow each other are one hop to Python."""
        spark, out = SparkSession.getActiveSession(), F.col(column) if isinstance(column, str) else column
        for part in self._hops(spark):
            if part is not self and part.fixed:
                out = jvm.run(spark, out, F.lit(",".join(part.names)), True)
            else:
                out = _in_python(part.compress)(out)
        return out

    def decompress_column(self, column: Column | str) -> Column:
        spark, out = SparkSession.getActiveSession(), F.col(column) if isinstance(column, str) else column
        for part in reversed(self._hops(spark)):
            if part is not self and part.fixed:
                out = jvm.run(spark, out, F.lit(",".join(part.names)), False)
            else:
                out = _in_python(part.decompress)(out)
        return out


class Builder:
    """Pipeline by steps."""

    def __init__(self) -> None:
        self.steps: list[Step] = []

    def add(self, step: str | Callable[[bytes], bytes], inverse: Callable[[bytes], bytes] | None = None) -> Builder:
        if isinstance(step, str):
            self.steps.append(codec_name(step))
        else:
            if inverse is None:
                raise ValueError("a function needs its inverse")
            self.steps.append((step, inverse))
        return self

    def build(self) -> Pipeline:
        return Pipeline(tuple(self.steps))

    def __str__(self) -> str:
        return " -> ".join(self.build().names) or "NONE"


def parse_pipelines(body: str | dict) -> dict[str, Pipeline]:
    """{column: [codec, ...]}, as an object or as JSON; anything else raises."""
    try:
        given = json.loads(body) if isinstance(body, str) else body
    except ValueError as e:
        raise ValueError(f"not a map of pipelines: {e}") from e
    if not isinstance(given, dict) or not all(isinstance(v, list) and all(isinstance(s, str) for s in v) for v in given.values()):
        raise ValueError("a map of pipelines has a list of codec names for each column")
    return {k: Pipeline.of(v) for k, v in given.items()}


#: match finding, then two entropy coders, as general compressors do
GENERAL = Pipeline.of(["LZ77", "FSE", "HUFFMAN"])
_DELTA, _RLE, _LZ = Pipeline.of(["DELTA"]), Pipeline.of(["RLE"]), Pipeline.of(["LZ77"])


def general_preset(columns: Sequence[str]) -> dict[str, Pipeline]:
    return dict.fromkeys(columns, GENERAL)


#: by what a column holds: keys in steps, flags in runs, text in repeats
TUNED: dict[str, Pipeline] = {
    **dict.fromkeys(("l_orderkey", "o_orderkey", "p_partkey", "s_suppkey", "c_custkey", "n_nationkey", "r_regionkey", "event_id"), _DELTA),
    **dict.fromkeys(("l_linenumber", "l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment", "p_size"), _RLE),
    **dict.fromkeys(("l_quantity", "l_discount", "l_tax", "p_name", "p_brand", "p_type", "c_name", "s_name", "n_name", "r_name"), _LZ),
}

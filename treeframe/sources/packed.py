"""Expressions as packed buffers: spans of narrow types in shared words, dictionaries, type runs, one heap.

A buffer holds, in this order: a header of six numbers of 4 bytes (mark, arguments, bytes of types, words,
words of dictionaries, bytes of the heap), the types, the words, the dictionaries and the heap.

* Types: the expressions are taken layer by layer, and the arguments of one after the other. A run of equal
  types is a byte of its id and flags; LENGTH means that 4 bytes of its length follow, CODED that its
  values are codes of a dictionary, whose number of values and place follow in 4 bytes each.
* Words of 64 bits: each run begins a new one; the first value is in the most significant field. Values of
  1 byte share a word by 8, of 2 by 4, of 4 by 2. Strings, symbols and bytes are places in the heap.
  An expression is the place of its head in the heap and the number of its arguments.
* Heap: 4 bytes of length and the bytes; equal ones are stored once.

Negative values keep to their field, and every length is the logical one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treeframe.operators.order import with_row_index
from treeframe.operators.pages import BYTE_ARRAY, DOUBLE, INT64, plain_decode, plain_encode
from treeframe.plans.pipeline import Pipeline
from treeframe.sources.build import TYPES, Expression, Symbol, type_name

KINDS = (*TYPES, "bytes")
#: fewest equal types that are written as a run with a length
RUN = 13
LENGTH, CODED = 0x80, 0x40
_MARK = 0x31504654
_DTYPE = {"bool": "u1", "char": "i1", "short": "<i2", "int": "<i4", "long": "<i8", "float": "<f4", "double": "<f8"}
_BITS = {"bool": 8, "char": 8, "short": 16, "int": 32, "float": 32}
_ONLY_SPANS = ("char", "short", "int", "float", "bytes")
#: rows of a buffer of a table
SPAN_ROWS = 1 << 16


class Span:
    """Values of one type, side by side as arguments; numbers as an array."""

    def __init__(self, kind: str, values: Sequence):
        if kind not in KINDS or kind == "expression":
            raise TypeError(f"no span has values of type {kind}")
        self.kind = kind
        self.values = np.asarray(values, np.dtype(_DTYPE[kind])) if kind in _DTYPE else list(values)

    def __len__(self) -> int:
        return len(self.values)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Span) and self.kind == other.kind and (np.array_equal(self.values, other.values, equal_nan=self.kind in ("float", "double")) if self.kind in _DTYPE else self.values == other.values)

    def __hash__(self) -> int:
        return hash((self.kind, len(self)))

    def __repr__(self) -> str:
        return f"Span({self.kind}, {list(self.values)})"


def pack_fields(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers as words of 64 bits, 64 / bits in each, the first in the most significant field."""
    per = 64 // bits
    raw = np.ascontiguousarray(values).view(f"<u{bits // 8}").astype(np.uint64)
    raw = np.r_[raw, np.zeros(-len(raw) % per, np.uint64)].reshape(-1, per)
    return np.bitwise_or.reduce(raw << (np.arange(per - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)), axis=1) if len(raw) else np.zeros(0, np.uint64)


def unpack_fields(words: np.ndarray, bits: int, n: int, dtype: str) -> np.ndarray:
    per = 64 // bits
    fields = words[:, None] >> (np.arange(per - 1, -1, -1, dtype=np.uint64) * np.uint64(bits))
    return fields.reshape(-1)[:n].astype(f"<u{bits // 8}").view(dtype)


class _Writer:
    def __init__(self, dict_strings: bool, dict_numbers: bool):
        self.dict_strings, self.dict_numbers = dict_strings, dict_numbers
        self.n = 0
        self.types: list[bytes] = []
        self.words: list[np.ndarray] = []
        self.dictionaries: list[np.ndarray] = []
        self.used = 0  # words of dictionaries
        self.heap = bytearray()
        self.place: dict[bytes, int] = {}

    def stored(self, raw: bytes) -> int:
        at = self.place.get(raw)
        if at is None:
            at = self.place[raw] = len(self.heap)
            self.heap += len(raw).to_bytes(4, "little") + raw
        return at

    def places(self, kind: str, values: list) -> np.ndarray:
        return np.fromiter((self.stored(bytes(v) if kind == "bytes" else str(v).encode()) for v in values), np.int64, len(values)).view(np.uint64)

    def run(self, kind: str, values: Any) -> None:
        n = len(values)
        if not n:
            return
        self.n += n
        kind_id, flags, more = KINDS.index(kind), 0, b""
        wide = values.view(np.uint64) if kind in ("long", "double") else None if kind in _DTYPE else self.places(kind, values)
        wanted = self.dict_strings if kind == "string" else self.dict_numbers if kind in ("long", "double") else False
        if wanted and n >= RUN:
            distinct, codes = np.unique(wide, return_inverse=True)
            # as long as codes of a byte do, and the dictionary is less than what it stands for
            if len(distinct) < 255 and 2 * len(distinct) < n:
                flags, more = CODED, struct.pack("<II", len(distinct), self.used)
                self.dictionaries.append(distinct)
                self.used += len(distinct)
                wide, kind = pack_fields(codes.astype("u1"), 8), "coded"
        if n >= RUN or kind in _BITS or flags:
            self.types.append(bytes([kind_id | LENGTH | flags]) + n.to_bytes(4, "little") + more)
        else:
            self.types.append(bytes([kind_id]) * n)
        self.words.append(pack_fields(values, _BITS[kind]) if kind in _BITS else wide)

    def expressions(self, args: list[Expression]) -> None:
        n = len(args)
        self.n += n
        self.types.append(bytes([KINDS.index("expression") | LENGTH]) + n.to_bytes(4, "little") if n >= RUN else bytes([KINDS.index("expression")]) * n)
        self.words.append(np.array([self.stored(e.head.encode()) << 32 | _arguments(e) for e in args], np.uint64))

    def buffer(self) -> bytes:
        types = b"".join(self.types)
        words, dictionaries = (np.concatenate(x).astype("<u8").tobytes() if x else b"" for x in (self.words, self.dictionaries))
        return struct.pack("<6I", _MARK, self.n, len(types), len(words) // 8, len(dictionaries) // 8, len(self.heap)) + types + words + dictionaries + bytes(self.heap)


def _arguments(e: Expression) -> int:
    return sum(len(a) if isinstance(a, Span) else 1 for a in e.args)


def _runs(args: list) -> Iterator[tuple[str, Any]]:
    """The arguments by runs of one type; spans stay as they are."""
    at = 0
    while at < len(args):
        if isinstance(args[at], Span):
            yield args[at].kind, args[at].values
            at += 1
            continue
        kind, end = type_name(args[at]), at
        while end < len(args) and not isinstance(args[end], Span) and type_name(args[end]) == kind:
            end += 1
        yield kind, args[at:end] if kind in ("string", "symbol", "expression") else np.array(args[at:end], _DTYPE[kind])
        at = end


def pack(root: Expression, dict_strings: bool = True, dict_numbers: bool = False) -> bytes:
    """The buffer of an expression. dict_...: strings, or longs and doubles, by codes of a byte where that pays."""
    out = _Writer(dict_strings, dict_numbers)
    out.expressions([root])
    layer = [root]
    while layer:
        below: list[Expression] = []
        for e in layer:
            for kind, values in _runs(e.args):
                if kind == "expression":
                    out.expressions(values)
                    below += values
                else:
                    out.run(kind, values)
        layer = below
    return out.buffer()


class Reader:
    """A cursor over a buffer: runs are read one after the other, and words only when asked for."""

    def __init__(self, buffer: bytes):
        mark, self.n, types, words, dictionaries, heap = struct.unpack_from("<6I", buffer)
        if mark != _MARK:
            raise ValueError("not a packed expression")
        at = struct.calcsize("<6I")
        self.types = buffer[at : at + types]
        self.words = np.frombuffer(buffer, "<u8", words, at + types)
        self.dictionaries = np.frombuffer(buffer, "<u8", dictionaries, at + types + 8 * words)
        self.heap = buffer[at + types + 8 * (words + dictionaries) :]
        if len(self.heap) != heap:
            raise ValueError("a packed expression is cut off")

    def runs(self) -> Iterator[tuple[str, int, tuple[int, int] | None, int]]:
        """(type, values, (first of the dictionary, its values), first word) of each run."""
        at, word = 0, 0
        while at < len(self.types):
            flags = self.types[at]
            kind, coded, at = KINDS[flags & 0x3F], None, at + 1
            n = 1
            if flags & LENGTH:
                n, at = int.from_bytes(self.types[at : at + 4], "little"), at + 4
            if flags & CODED:
                size, first = struct.unpack_from("<II", self.types, at)
                coded, at = (first, size), at + 8
            yield kind, n, coded, word
            bits = 8 if coded else _BITS.get(kind, 64)
            word += -(-n * bits // 64)

    def raw(self, place: int) -> bytes:
        n = int.from_bytes(self.heap[place : place + 4], "little")
        return self.heap[place + 4 : place + 4 + n]

    def values(self, kind: str, n: int, coded: tuple[int, int] | None, word: int) -> Any:
        """The values of a run: an array of numbers, or a list."""
        if kind in _BITS and not coded:
            bits = _BITS[kind]
            return unpack_fields(self.words[word : word + -(-n * bits // 64)], bits, n, _DTYPE[kind])
        if coded:
            first, size = coded
            wide = self.dictionaries[first : first + size][unpack_fields(self.words[word : word + -(-n // 8)], 8, n, "u1")]
        else:
            wide = self.words[word : word + n]
        if kind in _DTYPE:
            return np.ascontiguousarray(wide).view(_DTYPE[kind])
        made: dict[int, Any] = {}
        for p in set(wide.tolist()):
            raw = self.raw(p)
            made[p] = raw if kind == "bytes" else Symbol(raw.decode()) if kind == "symbol" else raw.decode()
        return [made[p] for p in wide.tolist()]

    def expression(self) -> Expression:
        """All of it; runs of 13 and more, and types that only spans have, come back as spans."""
        runs = self.runs()
        held: list = []  # what is left of the run that is open

        def take(n: int) -> list:
            out: list = []
            while n:
                if not held:
                    kind, size, coded, word = next(runs)
                    if kind == "expression":
                        for w in self.words[word : word + size].tolist():
                            held.append((Expression(self.raw(w >> 32).decode()), w & 0xFFFFFFFF))
                    elif size >= RUN or kind in _ONLY_SPANS:
                        out.append(Span(kind, self.values(kind, size, coded, word)))
                        n -= size
                        continue
                    else:
                        own = self.values(kind, size, coded, word)
                        held.extend((bool(v) if kind == "bool" else v, None) for v in (own.tolist() if kind in _DTYPE else own))
                v, size = held.pop(0)
                out.append(v)
                if size is not None:
                    below.append((v, size))
                n -= 1
            return out

        below: list[tuple[Expression, int]] = []
        (root,) = take(1)
        while below:
            layer, below = below, []
            for e, size in layer:
                e.args = take(size)
        return root


_OF_SPARK = {"boolean": "bool", "tinyint": "char", "smallint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string"}
_PHYSICAL = {"float": DOUBLE, "double": DOUBLE, "string": BYTE_ARRAY}


def _packed_batch(table: pa.Table, kinds: Mapping[str, str], chains: Mapping[str, Pipeline], dict_strings: bool, dict_numbers: bool) -> bytes:
    columns = []
    for name, kind in kinds.items():
        column = table.column(name).combine_chunks()
        null = np.asarray(column.is_null())
        present = column.drop_null()
        values = present.to_pylist() if kind == "string" else present.cast(pa.uint8()).to_numpy() if kind == "bool" else present.to_numpy(zero_copy_only=False)
        if name in chains:
            # narrow numbers are widened, as pages have three types
            data, taken = chains[name].compress_page(plain_encode(values, _PHYSICAL.get(kind, INT64)))
            body: list = [Expression("Page", *taken, Span("bytes", [data]))]
        else:
            body = [Span(kind, values)]
        columns.append(Expression(name, Symbol(kind), *([Span("bytes", [np.packbits(null).tobytes()])] if null.any() else []), Expression("Values", *body)))
    return pack(Expression("Table", *columns), dict_strings, dict_numbers)


def pack_table(
    df: DataFrame, order_by: str | list[str], columns: list[str] | None = None, pipelines: Mapping[str, Pipeline | Sequence] | None = None, dict_strings: bool = True, dict_numbers: bool = False, span_rows: int = SPAN_ROWS
) -> DataFrame:
    """span, first_row_index, n_rows, buffer: the columns in packed expressions of span_rows rows each.

    pipelines: codec chains by column; the values of such a column are a page in the buffer, encoded and
    compressed, and numbers are then not coded by dictionaries. Booleans, whole numbers, floating point
    and strings can be packed; other columns must be cast.
    """
    columns = df.columns if columns is None else columns
    found = {c: df.schema[c].dataType.simpleString() for c in columns}
    if wrong := [c for c, k in found.items() if k not in _OF_SPARK]:
        raise TypeError(f"columns {wrong} have types that can't be packed")
    kinds = {c: _OF_SPARK[k] for c, k in found.items()}
    chains = {c: p if isinstance(p, Pipeline) else Pipeline.of(p) for c, p in (pipelines or {}).items() if c in kinds}
    numbers = dict_numbers and not chains
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    rows = with_row_index(df.select(*[F.col(k).alias(f"tf_k{i}") for i, k in enumerate(keys)], *columns), [f"tf_k{i}" for i in range(len(keys))], "tf_row").drop(*(f"tf_k{i}" for i in range(len(keys))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("tf_row")
        first = table.column("tf_row")[0].as_py()
        return pa.table([pa.array([first // span_rows]), pa.array([first]), pa.array([table.num_rows]), pa.array([_packed_batch(table, kinds, chains, dict_strings, numbers)], pa.binary())], names=["span", "first_row_index", "n_rows", "buffer"])

    return rows.withColumn("tf_span", F.expr(f"tf_row div {span_rows}")).groupBy("tf_span").applyInArrow(run, "span long, first_row_index long, n_rows long, buffer binary")


def unpack_table(packed: DataFrame, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """row_index and the columns, of the types of the schema, from the rows of pack_table."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns = schema.names if columns is None else columns
    types = [to_arrow_type(schema[c].dataType) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, first = batch.column("n_rows")[i].as_py(), batch.column("first_row_index")[i].as_py()
                root = Reader(batch.column("buffer")[i].as_py()).expression()
                out = [pa.array(np.arange(first, first + n))]
                for c, t in zip(columns, types):
                    own = root[c]
                    kind, values = str(own[0]), own["Values"].args
                    null = np.unpackbits(np.frombuffer(own[1].values[0], np.uint8))[:n].astype(bool) if len(own.args) == 3 else np.zeros(n, bool)
                    out.append(_column(kind, values, null, t))
                yield pa.RecordBatch.from_arrays(out, ["row_index", *columns])

    fields = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in columns)
    return packed.select("first_row_index", "n_rows", "buffer").mapInArrow(run, f"row_index long, {fields}")


def _column(kind: str, values: list, null: np.ndarray, t: pa.DataType) -> pa.Array:
    if values and isinstance(values[0], Expression):
        page = values[0]
        names = [x for a in page.args[:-1] for x in (a.values if isinstance(a, Span) else [a])]
        present = pa.array(plain_decode(Pipeline.of(names).decompress(page.args[-1].values[0]), _PHYSICAL.get(kind, INT64)))
    else:
        flat = [x for v in values for x in (v.values if isinstance(v, Span) else [v])]
        present = pa.array(flat, pa.string()) if kind == "string" else pa.array(np.array(flat, _DTYPE[kind]))
    present = present.cast(t) if len(present) else pa.array([], t)
    return present.take(pa.array(np.where(null, 0, np.cumsum(~null) - 1), pa.int64(), mask=null))

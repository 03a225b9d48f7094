"""Token ids as binary blocks, with document boundaries in Elias-Fano code.

A block holds the ids of some documents, one after the other, in as few bytes as the vocabulary needs,
and their boundaries. For n documents of u ids together, each boundary keeps its floor(log2(u / n)) low
bits as they are, and the rest in unary: at most 2 bits a document. select(i) finds the i-th one in the
unary part from a sample of every 256th (32 bits each), so that an offset is read without a table of
64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.llm import text as tx
from treeframe.llm.bpe import VOCABULARY, Vocabulary, encoded
from treeframe.llm.repeats import fresh_name

#: ids of a block; a longer document has a block of its own
BLOCK_IDS = 4 << 20
_SAMPLE = 256
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


@dataclass
class EliasFano:
    """A sequence that never falls, of numbers from 0 to `last`."""

    n: int
    last: int
    width: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("numbers must not fall, nor be below 0")
        last = int(values[-1])
        width = max(0, (last // n).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)
        ones = (values >> width) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("a block is too large for 32-bit samples")
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, last, width, np.packbits(bits.reshape(-1)).tobytes(), np.packbits(unary).tobytes(), ones[::_SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        high = np.frombuffer(self.high, np.uint8)
        at = int(np.frombuffer(self.samples, "<u4")[i // _SAMPLE])
        # whole bytes from the sample on, until the rest of the ones lies in one of them
        byte, left = at >> 3, i % _SAMPLE + int(_ONES[high[at >> 3] >> (8 - (at & 7))])
        while left >= (c := int(_ONES[high[byte]])):
            left -= c
            byte += 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1]))[left])
        value = place - i
        if self.width:
            a, b = i * self.width, (i + 1) * self.width
            raw = np.unpackbits(np.frombuffer(self.low, np.uint8)[a >> 3 : (b + 7) >> 3])[a & 7 :][: self.width]
            for bit in raw.tolist():
                value = value << 1 | bit
        return value

    def decode(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8))[: self.n * self.width].reshape(self.n, self.width)
        low = np.zeros(self.n, np.int64)
        for k in range(self.width):
            low = low << 1 | bits[:, k]
        return high.astype(np.int64) << self.width | low

    @property
    def bits(self) -> int:
        return 8 * (len(self.low) + len(self.high) + len(self.samples))


def id_type(vocabulary_size: int) -> np.dtype:
    """The narrowest of 1, 2 and 4 bytes, little-endian."""
    if not 1 <= vocabulary_size <= 1 << 31:
        raise ValueError("a vocabulary has 1 to 2^31 ids")
    return np.dtype("u1" if vocabulary_size <= 1 << 8 else "<u2" if vocabulary_size <= 1 << 16 else "<u4")


_KINDS = {1: "u1", 2: "<u2", 4: "<u4"}
_FIELDS = ("block", "n_docs", "n_ids", "id_bytes", "ids", "low_bits", "low", "high", "samples")


def _written(ids: str, vocabulary_size: int, block_ids: int):
    kind = id_type(vocabulary_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        tokens: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            ef = EliasFano.encode(np.cumsum(size))
            doc = pa.concat_arrays(docs)
            row = [(part << 32) + seq, len(size), int(size.sum()), kind.itemsize, b"".join(tokens), ef.width, ef.low, ef.high, ef.samples]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, types)), pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)], [*_FIELDS, "doc_ids"])

        for batch in batches:
            column = batch.column(ids)
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                flat, offsets, _ = tx.string_bytes(column)
            else:
                offsets = np.asarray(column.offsets).astype(np.int64)
                # a null may hide ids; it counts as none
                size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
                flat = np.asarray(column.flatten())
                offsets = np.r_[0, np.cumsum(size)]
                if len(flat) and not (0 <= flat.min() and flat.max() < vocabulary_size):
                    raise ValueError("an id is outside the vocabulary")
            i, n = 0, len(offsets) - 1
            while i < n:
                j = min(n, max(int(np.searchsorted(offsets, offsets[i] + block_ids - held, "right")) - 1, i))
                if j == i and not held:
                    j = i + 1
                if j > i:
                    docs.append(batch.column("doc_id").slice(i, j - i))
                    sizes.append(np.diff(offsets[i : j + 1]))
                    tokens.append(np.asarray(flat[offsets[i] : offsets[j]]).astype(kind).tobytes())
                    held += int(offsets[j] - offsets[i])
                if j < n or held >= block_ids:
                    yield block()
                    seq, held, docs, sizes, tokens = seq + 1, 0, [], [], []
                i = j
        if docs:
            yield block()

    return run


_SCHEMA = "block long, n_docs long, n_ids long, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary, doc_ids array<{}>"


def bpe_token_blocks(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of the texts' ids under a byte-level BPE vocabulary, encoded and cut in one pass.

    As bpe_encode and token_blocks one after the other: null and empty texts are documents of no ids, in
    the order in which rows come; rows that are repeated are documents each; long texts are whole. Only
    doc_id and the text are read, so that other columns may have any names. An empty table gives no block.
    """
    v = Vocabulary.read(vocabulary)
    encode = encoded(docs.sparkSession.sparkContext.broadcast(v), ["doc_id"], text)
    write = _written("token_ids", len(v.tokens), block_ids)
    have = docs.select("doc_id", text)
    return have.mapInArrow(lambda batches: write(encode(batches)), _SCHEMA.format(have.schema["doc_id"].dataType.simpleString()))


def token_blocks(docs: DataFrame, ids: str = "token_ids", vocabulary_size: int = 50_256, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a block: ids and boundaries in binary, doc_ids in order.

    ids: a column of lists of ids, or a text, whose UTF-8 bytes are then the ids. Null lists and texts,
    and empty ones, are documents of no ids. Nothing is shuffled: each task cuts its rows into blocks as
    they come; rows that are repeated are documents each. An id outside the vocabulary, or null, is an
    error. Other columns may have any names. An empty table gives no block.
    """
    have = docs.select("doc_id", ids)
    kind = have.schema["doc_id"].dataType.simpleString()
    return have.mapInArrow(_written(ids, vocabulary_size, block_ids), _SCHEMA.format(kind))


def boundaries(row) -> EliasFano:
    """Of a row of token_blocks: where each document ends."""
    return EliasFano(row["n_docs"], row["n_ids"], row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))


def document(row, i: int) -> np.ndarray:
    """The ids of the i-th document of a block, found by two selects."""
    ends = boundaries(row)
    a, b = (ends.select(i - 1) if i else 0), ends.select(i)
    size = row["id_bytes"]
    return np.frombuffer(row["ids"], np.dtype(_KINDS[size]), b - a, a * size)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, block, offset, token_ids of every document in the blocks."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in _FIELDS}
                ends = boundaries(row).decode()
                begins = np.r_[0, ends[:-1]]
                ids = np.frombuffer(row["ids"], np.dtype(_KINDS[row["id_bytes"]])).astype(np.int32)
                doc = batch.column("doc_ids")[i].values
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(np.full(len(doc), row["block"])), pa.array(begins), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))], ["doc_id", "block", "offset", "token_ids"]
                )

    return blocks.select(*_FIELDS, "doc_ids").mapInArrow(run, f"doc_id {kind}, block long, offset long, token_ids array<int>")


def fetch(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, block, offset, token_ids of those documents in the blocks whose doc_id is in the other table.

    Offsets are found by select, two a document: no boundary of another document is decoded. A doc_id that
    several documents have gives them all; null finds nulls; one that none has gives nothing.
    """
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    other = fresh_name(wanted, "tf_id")
    ids = wanted.select(F.col("doc_id").alias(other)).distinct()
    places = blocks.select("block", F.posexplode("doc_ids").alias("i", "doc_id"))
    places = places.join(ids, F.col("doc_id").eqNullSafe(F.col(other)), "left_semi").groupBy("block").agg(F.collect_list("i").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in _FIELDS}
                at = sorted(batch.column("places")[i].as_py())
                ends = boundaries(row)
                own = [(ends.select(p - 1) if p else 0, ends.select(p)) for p in at]
                ids = np.frombuffer(row["ids"], np.dtype(_KINDS[row["id_bytes"]]))
                flat = np.concatenate([ids[a:b] for a, b in own]).astype(np.int32)
                cuts = np.r_[0, np.cumsum([b - a for a, b in own])].astype(np.int32)
                doc = batch.column("doc_ids")[i].values.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.full(len(at), row["block"])), pa.array([a for a, _ in own], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["doc_id", "block", "offset", "token_ids"])

    return blocks.join(places, "block").select(*_FIELDS, "doc_ids", "places").mapInArrow(run, f"doc_id {kind}, block long, offset long, token_ids array<int>")


def write_token_files(docs: DataFrame, path: str, ids: str = "token_ids", vocabulary_size: int = 50_256, block_ids: int = BLOCK_IDS) -> None:
    """Blocks as files in any file system that Spark can write."""
    token_blocks(docs, ids, vocabulary_size, block_ids).write.mode("errorifexists").option("compression", "none").parquet(path)


def size_report(blocks: DataFrame) -> DataFrame:
    """Of each block: bits a boundary in Elias-Fano code, against 64 in a table."""
    bits = 8 * (F.octet_length("low") + F.octet_length("high") + F.octet_length("samples"))
    return blocks.select("block", "n_docs", "n_ids", (bits / F.col("n_docs")).alias("bits_per_doc"), F.octet_length("ids").cast("long").alias("id_data_bytes"))

"""Byte-level BPE with a two-tier lookup.

Texts are cut into pre-tokens by the rules of the vocabulary's pattern, evaluated in numpy over code
points. Tier one: a minimal perfect hash of the vocabulary tells whether a pre-token is a token as a
whole. Tier two: other pre-tokens are merged by rank with a heap over a linked list of their bytes;
the result is remembered. Pre-tokens are told apart by 64-bit hashes; as every text is decoded again
and compared with the original, a collision is noticed, and that text is then encoded word by word.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from treeframe.llm import text as tx

#: ranks of a byte-level vocabulary of 50,256 tokens; any file of this format can be named instead
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_CHUNK = 1 << 20
#: pre-tokens that a worker remembers, at about 60 bytes each
_MEMO = 1_500_000
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0
RESULTS = ("token_ids", "n_tokens", "decodes")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, by hash and displace.

    Keys fall into buckets. Buckets of several keys, the largest first, get the least displacement that
    puts all their keys on free slots; a key alone in its bucket is sent straight to a slot that is left.
    """

    _BLOCK = 256

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys must be distinct")
        self.size, self.buckets = n, max(1, n // 3)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        taken = np.zeros(n, bool)
        #: a displacement, or -1 - slot
        self.shift = np.zeros(self.buckets, np.int64)
        self.index = np.zeros(n, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            own = order[ends[b] - sizes[b] : ends[b]]
            d = 0
            while True:
                tries = np.arange(d, d + self._BLOCK)
                slots = self._slot(keys[own][None, :], tries[:, None])
                fits = ~taken[slots].any(1)
                for k in np.flatnonzero(fits):
                    if len(np.unique(slots[k])) == len(own):
                        break
                else:
                    d += self._BLOCK
                    continue
                self.shift[b] = tries[k]
                taken[slots[k]] = True
                self.index[slots[k]] = own
                break
        alone = by_size[sizes[by_size] == 1]
        slot = np.flatnonzero(~taken)
        self.shift[alone] = -1 - slot
        self.index[slot] = order[ends[alone] - 1]

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (tx.mix(keys + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """For each key, the number of the only one of the set that it can be."""
        if not self.size:
            return np.zeros(len(keys), np.int64)
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return self.index[np.where(shift < 0, -1 - shift, self._slot(keys, shift))]


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = _LETTER if kind == "L" else _NUMBER
    for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = _BLANK
    return table


_CLASS: list[np.ndarray] = []


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which each pre-token starts, for each text the number of its first pre-token).

    The rules: contractions ('s 't 're 've 'm 'll 'd); letters, numbers or other signs, each with one
    space before; white space up to the last of it before a sign; other white space.
    """
    if not _CLASS:
        _CLASS.append(_classes())
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        at, cp = None, data
        fresh_at = offsets[:-1][np.diff(offsets) > 0]
    else:
        at = np.flatnonzero(lead)
        first = data[at].astype(np.uint32)
        size = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
        cp = np.where(first < 0x80, first, first & (0x3F >> (size - 1)).astype(np.uint32))
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            if len(more):
                cp[more] = (cp[more] << 6) | (data[at[more] + k] & 0x3F)
        fresh_at = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    m = len(cp)
    kind = _CLASS[0][cp]
    fresh = np.zeros(m + 1, bool)
    fresh[fresh_at] = True
    fresh[m] = True
    blank = kind == _BLANK
    space = cp == 0x20
    start = fresh[:m].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a sign takes the space before it; of white space before a sign, the last is a token of its own, if it isn't joined
    follows = np.zeros(m, bool)
    follows[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:m]
    joined = follows & space
    start |= follows
    taken = np.flatnonzero(joined) + 1
    start[taken] = False
    # contractions: an apostrophe that begins a token of one sign, before letters
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[quote + 1 < m]
    quote = quote[(kind[quote + 1] == _LETTER) & ~fresh[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        two = np.minimum(quote + 2, m - 1)
        inside = (quote + 2 < m) & (kind[two] == _LETTER) & ~fresh[np.minimum(quote + 2, m)]
        b = np.where(inside, cp[two], 0)
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        both = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        hit = one | both
        q, size = quote[hit], np.where(one, 1, 2)[hit]
        start[q + 1] = False
        after = q + 1 + size
        after = after[after < m]
        start[after[~fresh[after] & (kind[after] == _LETTER)]] = True
    tokens = np.flatnonzero(start)
    begin = tokens if at is None else at[tokens]
    return begin, np.searchsorted(begin, offsets)


class Vocabulary:
    """Tokens by rank, with the perfect hash of those that can be whole pre-tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        if len(self.ranks) != len(tokens) or not all(bytes([b]) in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has distinct tokens, all 256 bytes among them")
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        self.sizes = np.diff(np.r_[0, ends]).astype(np.int64)
        self.starts = ends - self.sizes
        self.column = pa.array(tokens, pa.large_binary())
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.hash = PerfectHash(tx.Rolling(self.bytes)(self.starts, ends))

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
        ranked = sorted((int(r), base64.b64decode(t)) for t, r in pairs)
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must be 0, 1, 2 ...")
        return cls([t for _, t in ranked])

    def __getstate__(self) -> dict:
        """Without what a process makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k not in ("_pairs", "_encoder")}

    @property
    def pairs(self) -> list[dict[int, int]]:
        """Of each token, the tokens that may follow it and the rank of both together; made once by each process."""
        if "_pairs" not in self.__dict__:
            ranks, none = self.ranks, {}
            out: list[dict[int, int]] = [none] * len(self.tokens)
            for t, r in ranks.items():
                for k in range(1, len(t)):
                    if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                        if out[a] is none:
                            out[a] = {}
                        out[a][b] = r
            self._pairs = out
        return self._pairs

    @property
    def encoder(self) -> Encoder:
        """One for all tasks of a process, so that what it learnt stays."""
        if "_encoder" not in self.__dict__:
            self._encoder = Encoder(self)
        return self._encoder

    def merged(self, word: bytes) -> list[int]:
        """The ranks of a pre-token: pairs of neighbours are merged, the least rank and then the leftmost first."""
        pairs = self.pairs
        n = len(word)
        part = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: of the pair that begins at a part, its rank now
        rank = [pairs[a].get(b, -1) for a, b in zip(part, part[1:])]
        rank.append(-1)
        shift = n.bit_length()
        last = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & last, top >> shift
            if rank[i] != r:
                continue  # one of the two has changed since
            j = after[i]
            part[i], part[j], rank[j] = r, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = q = pairs[r].get(part[k], -1)
                if q >= 0:
                    heappush(heap, q << shift | i)
            else:
                rank[i] = -1
            k = before[i]
            if k >= 0:
                rank[k] = q = pairs[part[k]].get(r, -1)
                if q >= 0:
                    heappush(heap, q << shift | k)
        return [p for p in part if p >= 0]

    def whole(self, words: list[bytes], keys: np.ndarray) -> list[int]:
        """The rank of each word that is a token, -1 for others, by the perfect hash."""
        return [r if self.tokens[r] == w else -1 for r, w in zip(self.hash(keys).tolist(), words)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.decoded(ids)[0]

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, one after the other; where each begins, and the end)."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        _, offsets, data = self.column.take(pa.array(ids)).buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
        return np.frombuffer(data, np.uint8)[: ends[-1]], ends

    def decodes(self, ids: np.ndarray, bound: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, whether its ids give its bytes."""
        own, ends = self.decoded(ids)
        ends = ends[bound]
        if np.array_equal(ends, offsets) and np.array_equal(own, data):
            return np.ones(len(offsets) - 1, bool)
        return np.array([np.array_equal(own[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])], bool)


class Numbers:
    """Numbers 0, 1, 2 ... of distinct 64-bit keys, by open addressing in arrays: some bytes a key, and no object."""

    def __init__(self, room: int = 1 << 16):
        self.n = 0
        self.keys, self.number = np.zeros(room, np.uint64), np.full(room, -1, np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(todo):
            number = self.number[at]
            hit = (number >= 0) & (self.keys[at] == keys[todo])
            out[todo[hit]] = number[hit]
            on = ~hit & (number >= 0)
            todo, at = todo[on], (at[on] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that have none yet get the next numbers, in order."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            have = self.number >= 0
            old, number = self.keys[have], self.number[have]
            room = 1 << int(4 * (self.n + len(keys))).bit_length()
            self.keys, self.number = np.zeros(room, np.uint64), np.full(room, -1, np.int32)
            self._put(old, number)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.keys) - 1
        todo, at = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.number[at] < 0)
            # of keys that want the same place the last one gets it
            self.number[at[free]] = number[todo[free]]
            got = np.zeros(len(todo), bool)
            got[free] = self.number[at[free]] == number[todo[free]]
            self.keys[at[got]] = keys[todo[got]]
            todo, at = todo[~got], (at[~got] + 1) & mask


class Encoder:
    """Encodes batches; what it learnt of pre-tokens stays, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        v = self.vocabulary
        flat: list[int] = []
        count = np.empty(len(words), np.int32)
        for i, (w, r) in enumerate(zip(words, v.whole(words, keys))):
            before = len(flat)
            if r >= 0:
                flat.append(r)
            else:
                flat += v.merged(w)
            count[i] = len(flat) - before
        n = self.known.n
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while n + len(words) > len(self.at):
            self.at, self.size = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.size, np.zeros_like(self.size)]
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(words)] = self.used + np.cumsum(count) - count
        self.size[n : n + len(words)] = count
        self.used += len(flat)
        self.known.add(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets into them, whether they decode) of some texts."""
        start, first = pretokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.ones(len(offsets) - 1, bool)
        end = np.r_[start[1:], len(data)]
        code, distinct = pd.factorize(tx.Rolling(data)(start, end))
        if self.known.n + len(distinct) > _MEMO:
            self._forget()
        number = self.known(distinct)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            example = np.empty(len(distinct), np.int64)
            example[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            raw = data.tobytes()
            at = example[missing]
            number[missing] = np.arange(self.known.n, self.known.n + len(missing))
            self._learn(distinct[missing], [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())])
        slot = number[code]
        size = self.size[slot]
        ids = self.ids[tx.ragged(self.at[slot], size)]
        bound = np.r_[0, np.cumsum(size)][first]
        same = self.vocabulary.decodes(ids, bound, data, offsets)
        if not same.all():
            ids, bound = self._slowly(data, offsets, start, end, first)
            same = self.vocabulary.decodes(ids, bound, data, offsets)
        return ids, bound, same

    def _slowly(self, data, offsets, start, end, first) -> tuple[np.ndarray, np.ndarray]:
        """Without hashes in place of words."""
        raw, v = data.tobytes(), self.vocabulary
        lists = [[v.ranks[w]] if (w := raw[s:e]) in v.ranks else v.merged(w) for s, e in zip(start.tolist(), end.tolist())]
        return np.array([i for x in lists for i in x], np.int32), np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)[first]


def encoded(sent, columns: list[str], text: str):
    """What a task does with its batches: the named columns and the three results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder
        for batch in batches:
            data, offsets, valid = tx.string_bytes(batch.column(text))
            for i, j in tx.pieces(offsets, _CHUNK):
                sub = data[offsets[i] : offsets[j]]
                ids, bound, same = encoder.encode(sub, offsets[i : j + 1] - offsets[i])
                null = pa.array(~valid[i:j])
                n = j - i
                lists = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(ids), mask=null)
                part = batch.slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), lists, pa.array(np.diff(bound).astype(np.int32), mask=~valid[i:j]), pa.array(same, mask=~valid[i:j])],
                    [*columns, *RESULTS],
                )

    return run


def bpe_encode(docs: DataFrame, columns: list[str] | None = None, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns (doc_id, if none are named) with token_ids, n_tokens, and whether decoding gave the text.

    Null texts have null in all three; empty texts no tokens. Long texts are encoded to their end. No
    special token is ever made from text. Rows that are repeated are encoded each; an empty table gives
    none. Named columns that are called as one of the three results are replaced by it.
    """
    columns = [c for c in (["doc_id"] if columns is None else columns) if c.lower() not in RESULTS]
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    have = docs.select(*dict.fromkeys([*columns, text]))
    kinds = ", ".join(f"`{c}` {have.schema[c].dataType.simpleString()}" for c in columns)
    return have.mapInArrow(encoded(sent, columns, text), f"{kinds}, token_ids array<int>, n_tokens int, decodes boolean")


def bpe_decode(tokens: DataFrame, columns: list[str] | None = None, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns (doc_id, if none are named) with the text of the ids; null ids give null text.

    Bytes that aren't UTF-8, as a cut list of ids can have, become U+FFFD. An id outside the vocabulary is
    an error. Rows that are repeated are decoded each; an empty table gives none.
    """
    columns = ["doc_id"] if columns is None else columns
    if "text" in {c.lower() for c in columns}:
        raise ValueError("column text is the result")
    sent = tokens.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            out = [None if x is None else v.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], [*columns, "text"])

    have = tokens.select(*dict.fromkeys([*columns, ids]))
    kinds = ", ".join(f"`{c}` {have.schema[c].dataType.simpleString()}" for c in columns)
    return have.mapInArrow(run, f"{kinds}, text string")

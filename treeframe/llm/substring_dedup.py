"""Substring dedup with suffix automata.

Documents are streamed, in order, through the suffix automaton of a reference shard: the text that
came before them. The matching statistics say at each word how many words up to it occur in the
shard; where that reaches the threshold, a repeat ends. What isn't there yet is added, so that the
automaton grows with the stream.

The reference is the corpus itself, so its automata can't go whole to every executor: each passage is
sent instead to the one shard that can hold its like (see repeats.py). For a reference table of its
own, broadcast_matches sends the automata of its shards to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeframe.llm import text as tx
from treeframe.llm.repeats import WINDOW, keyed, merged, repeated_spans, without_spans
from treeframe.llm.store import written

_CHUNK = 1 << 20


class SuffixAutomaton:
    """Of a set of word sequences, grown one at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and (q := nxt[p].get(w)) is None:
                    nxt[p][w] = cur
                    p = link[p]
                last = cur
                if p == -1:
                    continue
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            else:
                p, cur = last, -1
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            if cur != -1:
                link[cur] = clone
            else:
                last = clone
            while p != -1 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest run of words ending there that the automaton has."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def automaton_matcher(passages: list[list[bytes]], window: int) -> list[list[int]]:
    automaton, out = SuffixAutomaton(), []
    for words in passages:
        hits = [i - window + 1 for i, n in enumerate(automaton.statistics(words)) if n >= window]
        out.append(hits)
        if len(hits) < len(words) - window + 1:
            automaton.add(words)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, n_words of each maximal span of at least `window` words that occurred before.

    Words are runs of bytes other than ASCII white space, counted from 0. Null, empty and short texts
    have no spans; rows with the same doc_id and text count as one document; an empty table gives none.
    Long texts are whole; other columns may have any names. See repeats.py for which passages reach an
    automaton.
    """
    return repeated_spans(docs, automaton_matcher, window).drop("rh")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the spans that substring_dedup finds; those of which nothing is left go."""
    return without_spans(docs, repeated_spans(docs, automaton_matcher, window))


class Reference:
    """Some shards of a reference table: lists of texts, as lists of words."""

    def __init__(self, shards: list[list[list[bytes]]]):
        self.shards = shards

    def __getstate__(self) -> dict:
        return {"shards": self.shards}

    @property
    def automata(self) -> list[SuffixAutomaton]:
        """One a shard, made once by each Python process."""
        if "_automata" not in self.__dict__:
            self._automata = []
            for shard in self.shards:
                automaton = SuffixAutomaton()
                for words in shard:
                    automaton.add(words)
                self._automata.append(automaton)
        return self._automata

    def pieces(self, piece: int) -> np.ndarray:
        """The sorted hashes of all runs of `piece` words, made once by each process."""
        if "_pieces" not in self.__dict__:
            found = [np.zeros(0, np.uint64)]
            for words in (w for shard in self.shards for w in shard):
                raw = b" ".join(words)
                starts, ends, _ = tx.words(data := np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                at = np.arange(len(starts) - piece + 1)
                found.append(tx.word_hashes(tx.Rolling(data)(starts, ends))(at, at + piece))
            self._pieces = np.unique(np.concatenate(found))
        return self._pieces


def reference_groups(reference: DataFrame, window: int, shard_words: int, most_bytes: int) -> Iterator[Reference]:
    """The texts of the table, streamed to the driver, in groups of shards of at most most_bytes of words.

    A text longer than a shard is cut into parts that overlap by all but one word of a window, so that
    each window is in one of them.
    """
    shards: list[list[list[bytes]]] = [[]]
    words = size = 0
    for (t,) in reference.select("text").where(F.col("text").isNotNull()).toLocalIterator():
        own = t.encode().split()
        step = max(1, shard_words - window + 1)
        for a in range(0, max(1, len(own) - window + 1), step):
            part = own[a : a + step + window - 1]
            if len(part) < window:
                continue
            room = sum(map(len, part)) + 9 * len(part)
            if size and size + room > most_bytes:
                yield Reference([s for s in shards if s])
                shards, words, size = [[]], 0, 0
            elif words and words + len(part) > shard_words:
                shards.append([])
                words = 0
            shards[-1].append(part)
            words, size = words + len(part), size + room
    if size:
        yield Reference([s for s in shards if s])


def _statistics(sent, window: int):
    piece = min(8, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Reference = sent.value
        hashes, automata = known.pieces(piece), known.automata
        for batch in batches:
            data, offsets, _ = tx.string_bytes(batch.column("text"))
            row: list[int] = []
            found: list[int] = []
            for i, j in tx.pieces(offsets, _CHUNK):
                sub = data[offsets[i] : offsets[j]]
                starts, ends, first = tx.words(sub, offsets[i : j + 1] - offsets[i])
                if len(starts) < window:
                    continue
                at = np.arange(len(starts) - piece + 1)
                h = tx.word_hashes(tx.Rolling(sub)(starts, ends))(at, at + piece)
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                there = np.r_[0, np.cumsum(hashes[where] == h), np.zeros(0, np.int64)]
                # a window can only be there if all of its pieces are; such documents are streamed through the automata
                width = window - piece + 1
                hit = np.flatnonzero(there[width:] - there[:-width] == width)
                raw = sub.tobytes()
                for d in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                    a, b = int(first[d]), int(first[d + 1])
                    words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    for automaton in automata:
                        own = [k - window + 1 for k, n in enumerate(automaton.statistics(words)) if n >= window]
                        row += [i + d] * len(own)
                        found += own
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("rh").take(rows), pa.array(found, pa.int32()), pa.array(np.full(len(found), window, np.int32))], ["doc_id", "rh", "w", "n"])

    return run


def broadcast_matches(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 20_000, most_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, start_word, n_words of the maximal spans of the documents that occur in a reference table (column text).

    The reference is cut into shards; each process builds their suffix automata once, and streams documents
    through them. At most most_bytes of the reference are broadcast at once: a larger one takes several
    passes over the documents, the spans of each being written. Documents none of whose windows has all
    its pieces of 8 words among the reference's, by hash, aren't streamed. Nulls, and texts of fewer words
    than the window, on either side have no spans; repeated rows of documents are one; other columns may
    have any names; an empty table on either side gives no spans.
    """
    own = keyed(docs)
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, rh long, w int, n int"
    spans = docs.sparkSession.createDataFrame([], schema)
    for group in reference_groups(reference, window, shard_words, most_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(group)
        spans = spans.unionByName(written(own.mapInArrow(_statistics(sent, window), schema), "spans"))
        sent.unpersist()
    return merged(spans).drop("rh")

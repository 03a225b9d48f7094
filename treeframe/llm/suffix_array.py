"""Suffix-array dedup: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from treeframe.llm.repeats import WINDOW, repeated_spans

#: words of one suffix array; the passages of a task are cut into shards of so many
ARRAY_WORDS = 16_000


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling: a round sorts only the suffixes of groups not yet told apart."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    value = tokens[order]
    head = np.r_[True, value[1:] != value[:-1]]
    # the rank of a group is the place of its last member, as then ranks only fall
    last = np.r_[np.flatnonzero(head)[1:] - 1, n - 1]
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, np.diff(np.r_[np.flatnonzero(head), n]))
    h = 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank[order]] > 1)
    while len(open_) and h < n:
        at = order[open_]
        far = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        mine = rank[at]
        by = np.lexsort((far, mine))
        at, far, mine = at[by], far[by], mine[by]
        order[open_] = at
        new = np.r_[True, (mine[1:] != mine[:-1]) | (far[1:] != far[:-1])]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(at)])
        rank[at] = np.repeat(open_[begin + size - 1], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order


def kasai(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: words that the suffixes order[i - 1] and order[i] share; lcp[0] = 0."""
    n = len(tokens)
    t, o = tokens.tolist(), order.tolist()
    place = [0] * n
    for i, s in enumerate(o):
        place[s] = i
    lcp, h = [0] * n, 0
    for i in range(n):
        p = place[i]
        if p:
            j = o[p - 1]
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            lcp[p] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return np.array(lcp, np.int64)


def found_in(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Which rows of `queries` (words) begin some suffix: a binary search of all of them at once."""
    n, width = len(tokens), queries.shape[1]
    padded = np.r_[tokens, np.full(width, np.iinfo(np.int64).min)]
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
    steps = np.arange(width)

    def against(mid: np.ndarray) -> np.ndarray:
        """Sign of suffix minus query on the first words."""
        own = padded[order[mid][:, None] + steps]
        differ = own != queries
        k = differ.argmax(1)
        rows = np.arange(len(mid))
        return np.where(differ.any(1), np.where(own[rows, k] < queries[rows, k], -1, 1), 0)

    for _ in range(int(n).bit_length() + 1):
        todo = low < high
        if not todo.any():
            break
        mid = np.minimum((low + high) // 2, n - 1)
        less = against(mid) < 0
        low = np.where(todo & less, mid + 1, low)
        high = np.where(todo & ~less, mid, high)
    return (low < n) & (against(np.minimum(low, n - 1)) == 0)


def suffix_array_matcher(passages: list[list[bytes]], window: int) -> list[list[int]]:
    """Shards in order; in each, suffixes whose common prefixes reach the window are equal, and the
    first of them is looked up in the shards before."""
    if not passages:
        return []
    sizes = np.array([len(p) for p in passages])
    ids = pd.factorize(pd.Series([w for p in passages for w in p], dtype=object))[0].astype(np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    hit = np.zeros(len(ids), bool)
    shards: list[tuple[np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(passages):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + ARRAY_WORDS, "right")) - 1)
        # passages are parted by numbers that occur once
        count = np.diff(offsets[a : b + 1])
        tokens = np.empty(offsets[b] - offsets[a] + b - a, np.int64)
        place = np.arange(offsets[b] - offsets[a]) + np.repeat(np.arange(b - a), count)
        tokens[:] = -1 - np.arange(len(tokens))
        tokens[place] = ids[offsets[a] : offsets[b]]
        order = suffix_array(tokens)
        lcp = kasai(tokens, order)
        group = np.cumsum(lcp < window)
        begins = count - window + 1
        real = np.full(len(tokens), -1, np.int64)
        real[place] = np.arange(offsets[a], offsets[b])
        usable = np.zeros(len(tokens), bool)
        head = np.r_[0, np.cumsum(count + 1)[:-1]]
        for s, k in zip(head.tolist(), begins.tolist()):
            usable[s : s + max(k, 0)] = True
        ok = usable[order]
        at, group = order[ok], group[ok]
        by = np.lexsort((at, group))
        at, group = at[by], group[by]
        first = np.r_[True, group[1:] != group[:-1]] if len(at) else np.zeros(0, bool)
        hit[real[at[~first]]] = True
        lead = at[first]
        known = np.zeros(len(lead), bool)
        for t, o in shards:
            ask = np.flatnonzero(~known)
            if len(ask):
                known[ask] = found_in(t, o, tokens[lead[ask][:, None] + np.arange(window)])
        if known.any():
            label = np.cumsum(first) - 1
            hit[real[at[known[label]]]] = True
        shards.append((tokens, order))
        a = b
    return [np.flatnonzero(hit[offsets[i] : offsets[i + 1]]).tolist() for i in range(len(passages))]


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, n_words of each maximal span of at least `window` words that occurred before.

    Null, empty and short texts have no spans; rows with the same doc_id and text count as one
    document; an empty table gives none. Long texts are whole; other columns may have any names. See
    repeats.py for which passages reach a suffix array.
    """
    return repeated_spans(docs, suffix_array_matcher, window).drop("rh")

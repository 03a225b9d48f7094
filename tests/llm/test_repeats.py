import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeframe.llm import repeats
from treeframe.llm.repeats import passages_of, repeated_spans
from treeframe.llm.substring_dedup import SuffixAutomaton, automaton_matcher, broadcast_matches, reference_groups, remove_repeats, substring_dedup
from treeframe.llm.suffix_array import found_in, kasai, suffix_array, suffix_array_dedup, suffix_array_matcher


def brute(rows, window):
    """All spans, from a dictionary of windows."""
    seen, spans = set(), []
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    # two texts of one doc_id would be ordered by hash; the tests have none
    for d, t in docs:
        words = t.encode().split()
        marks = np.zeros(len(words) + 1, int)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                marks[i : i + window] = 1
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[0, marks]))
        spans += [(d, int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    return sorted(spans, key=repr)


@pytest.mark.parametrize("find", [substring_dedup, suffix_array_dedup])
@pytest.mark.parametrize("window", [8, 50])
def test_against_brute_force(docs, corpus, find, window):
    got = sorted(map(tuple, find(docs, window).collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in corpus], window)
    assert got


@pytest.mark.parametrize("find", [substring_dedup, suffix_array_dedup])
def test_no_rows_and_other_columns(docs, empty, clashing, find):
    assert find(empty).count() == 0 and find(empty).columns == ["doc_id", "start_word", "n_words"]
    assert sorted(map(repr, find(clashing).collect())) == sorted(map(repr, find(docs).collect()))


def test_small_shards(docs, corpus):
    for matcher in (automaton_matcher, suffix_array_matcher):
        got = sorted(map(tuple, repeated_spans(docs, matcher, 10, 4, shard_words=100).drop("rh").collect()), key=repr)
        assert got == brute([(r[0], r[1]) for r in corpus], 10)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), max_size=6))
def test_matchers_agree(passages):
    seen, want = set(), []
    for p in passages:
        hits = [i for i in range(len(p) - 2) if tuple(p[i : i + 3]) in seen]
        want.append(hits)
        seen |= {tuple(p[i : i + 3]) for i in range(len(p) - 2)}
    # an automaton knows only what came in earlier passages; an array also what came earlier in this one
    assert automaton_matcher(passages, 3) == want
    got = suffix_array_matcher(passages, 3)
    inner = [sorted(set(w) | {i for i in range(len(p) - 2) if p[i : i + 3] in [p[j : j + 3] for j in range(i)]}) for p, w in zip(passages, want)]
    assert got == inner


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(values):
    t = np.array(values, np.int64)
    order = suffix_array(t)
    assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    lcp = kasai(t, order)
    for i in range(1, len(values)):
        a, b = values[order[i - 1] :], values[order[i] :]
        assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    if len(values) >= 2:
        asked = np.array([[x, y] for x in range(4) for y in range(4)])
        pairs = set(zip(values, values[1:]))
        assert found_in(t, order, asked).tolist() == [(x, y) in pairs for x, y in asked.tolist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=5), st.text("abc", max_size=15))
def test_matching_statistics(texts, query):
    a = SuffixAutomaton()
    for t in texts:
        a.add(list(t))
    want = [max(k for k in range(i + 2) if any(query[i + 1 - k : i + 1] in t for t in [*texts, ""])) for i in range(len(query))]
    assert a.statistics(list(query)) == want


def test_passages_cover_all_windows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 3, 40, 9, 10, 200)]
    raw = [t.encode() for t in texts]
    p = passages_of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], 10, 3)
    covered = sorted((r, w + i) for r, w, n in zip(p["row"].tolist(), p["w0"].tolist(), p["nw"].tolist()) for i in range(n))
    assert covered == [(r, i) for r, t in enumerate(texts) for i in range(len(t.split()) - 9)]
    assert p["nw"].max() <= 10 - 3 + 1


def test_removal(docs, corpus, empty, clashing):
    left = {(r.doc_id, r.text): r for r in remove_repeats(docs).collect()}
    spans = brute([(r[0], r[1]) for r in corpus], 50)
    assert remove_repeats(empty).count() == 0
    assert sorted(remove_repeats(clashing).columns) == sorted(clashing.columns)
    by_doc = {}
    for d, a, n in spans:
        by_doc.setdefault(d, set()).update(range(a, a + n))
    for d, text, *_ in corpus:
        words = (text or "").split()
        kept = " ".join(w for i, w in enumerate(words) if i not in by_doc.get(d, ()))
        found = [r for (i, t), r in left.items() if i == d and " ".join((t or "").split()) == kept]
        # a document of which nothing is left is gone
        assert found or (d in by_doc and not kept)
        if found and text is not None:
            assert found[0].n_chars == len(found[0].text)
            assert d in by_doc or found[0].text == text


@pytest.mark.parametrize("hot", [{"hot_rows": 2}, {"hot_passages": 1}, {"hot_rows": 20, "hot_passages": 3}, {"hot_rows": 0}])
@pytest.mark.parametrize("keys", [0, 10**6])
def test_hot_minimizers(docs, corpus, hot, keys, monkeypatch):
    """However many passages of one minimizer count as many, and with or without a broadcast: the same spans."""
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", keys)
    matcher = automaton_matcher if keys else suffix_array_matcher
    got = sorted(map(tuple, repeated_spans(docs, matcher, 10, 4, **hot).drop("rh").collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in corpus], 10)


def test_one_line_in_many_documents(spark):
    """A line of a piece's length, between other words each time, and a longer passage."""
    rng = random.Random(2)
    some = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    line, passage = "this very line stands everywhere", some(25)
    rows = [(i, f"{some(12)} {line} {some(12)}" + (f" {passage} {some(3)}" if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in ({}, {"hot_rows": 10}, {"hot_passages": 5}):
        assert sorted(map(tuple, repeated_spans(df, automaton_matcher, 20, 5, **hot).drop("rh").collect()), key=repr) == brute(rows, 20)


def brute_reference(rows, reference, window):
    known = {tuple(w[i : i + window]) for t in reference if t for w in [t.split()] for i in range(len(w) - window + 1)}
    spans = []
    for d, t in {(d, t) for d, t in rows if t}:
        w = t.split()
        marks = np.zeros(len(w) + 1, int)
        for i in range(len(w) - window + 1):
            if tuple(w[i : i + window]) in known:
                marks[i : i + window] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, marks]))
        spans += [(d, int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2])]
    return sorted(spans, key=repr)


@pytest.mark.parametrize(("shard", "most"), [(20_000, 8 << 20), (30, 500), (12, 1)])
@pytest.mark.parametrize("window", [5, 12])
def test_broadcast_reference(spark, docs, corpus, empty, clashing, window, shard, most):
    """One shard, several, and one broadcast after the other; long texts are cut with an overlap."""
    texts = [next(r[1] for r in corpus if r[0] == i) for i in (60, 2, 7)] + [None, "", "short", "word " * 30]
    ref = spark.createDataFrame([(t, "x") for t in texts], "text string, doc_id string")
    if most > 1:
        got = broadcast_matches(docs, ref, window, shard, most)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_reference([(r[0], r[1]) for r in corpus], texts, window)
    else:
        few = ref.where("text LIKE 'word%'")
        assert sorted(map(tuple, broadcast_matches(clashing, few, window, shard, most).collect()), key=repr) == brute_reference([(r[0], r[1]) for r in corpus], ["word " * 30], window)
        assert broadcast_matches(empty, few, window).count() == 0 and broadcast_matches(docs, ref.limit(0), window).count() == 0


def test_reference_groups_hold_every_window(spark):
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(1000)}" for _ in range(n)) for n in (4, 5, 30, 100, 17)]
    ref = spark.createDataFrame([(t,) for t in texts], "text string")
    for shard, most in ((10, 10**6), (25, 700), (1000, 1)):
        groups = list(reference_groups(ref, 5, shard, most))
        have = {tuple(w[i : i + 5]) for g in groups for s in g.shards for w in s for i in range(len(w) - 4)}
        assert have == {tuple(w[i : i + 5]) for t in texts for w in [t.encode().split()] for i in range(len(w) - 4)}
        assert all(sum(map(len, s)) <= max(shard + 4, shard) + 4 for g in groups for s in g.shards)

"""Pages of strings: the same, whatever tasks their rows are in, and without a join or shuffle of values."""

from glob import glob

import pytest

from treeframe import queries
from treeframe.operators import pages as pg
from treeframe.operators.order import scratch
from treeframe.plans.pipeline import Pipeline
from treeframe.plans.scan import read_column

LIMIT = 300
TEXTS = [None if i % 11 == 0 else "" if i % 13 == 0 else f"é{i % 7} " * (i % 29) + ("x" * 900 if i % 101 == 7 else "") for i in range(1500)]


def greedy():
    """Rows of each page."""
    out, used = [], 0
    for i, t in enumerate(TEXTS):
        n = 0 if t is None else len(t.encode()) + 4
        if not out or used + n > LIMIT:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out


@pytest.fixture
def frame(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame([(2 * i, t) for i, t in enumerate(TEXTS)], "id long, s string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["stored", "mixed", "joined", "python", "skips"])
def test_pages(frame, monkeypatch, how):
    """F2"""
    chain = Pipeline.of(["LZ77", "FSE"], skip_if_larger=how == "skips")
    if how == "joined":
        monkeypatch.setattr(pg, "MOST_STARTS", 0)
    if how == "python":
        monkeypatch.setattr(pg.jvm, "available", lambda spark: False)
    rows = pg.values(frame, "s", "id", key="id")
    if how == "mixed":
        rows = rows.repartition(5)
    pages = pg.encode_rows(rows, "s", pg.BYTE_ARRAY, chain, LIMIT)
    got = sorted(pages.collect(), key=lambda r: r.page_no)
    want = greedy()
    assert [r.page_no for r in got] == list(range(len(want)))
    for r, own in zip(got, want):
        texts = [TEXTS[i] for i in own if TEXTS[i] is not None]
        raw = pg.plain_encode(texts, pg.BYTE_ARRAY)
        data, taken = chain.compress_page(raw)
        assert (bytes(r.page_data), r.codecs, r.compressed_size, r.uncompressed_size) == (data, taken, len(data), len(raw))
        assert (r.first_row_index, r.n_rows, r.n_values, r.null_count, r.distinct_count) == (own[0], len(own), len(texts), len(own) - len(texts), len(set(texts)))
        assert (r.min_string, r.max_string) == ((min(texts, key=str.encode), max(texts, key=str.encode)) if texts else (None, None))
        assert r["keys"] == [2 * i for i in own]
    back = {r.row_index: (r.key, r.value) for r in read_column(pages, "s", pg.BYTE_ARRAY).collect()}
    assert back == {i: (2 * i, t) for i, t in enumerate(TEXTS)}


def test_pages_of_several_parts(spark, frame):
    """Some pages have rows of more than one task: those alone are put together."""
    path = f"{scratch(spark)}/pages-*-joined".removeprefix("file:")
    before = set(glob(path))
    pages = pg.encode_column(frame, "s", "id", ["FSE"], LIMIT)
    (made,) = set(glob(path)) - before
    assert 0 < spark.read.parquet(made).count() < 50 < pages.count() == len(greedy())


def test_no_rows(frame):
    assert read_column(pg.encode_column(frame.limit(0), "s", "id", ["FSE"], LIMIT, key="id"), "s", pg.BYTE_ARRAY).collect() == []


@pytest.mark.parametrize("name", ["fse", "lz77", "huffman", "lzw"])
def test_values_are_not_shuffled(spark, name):
    """what is read from pages isn't joined to its rows again."""
    out = queries.QUERIES[f"{name}_roundtrip"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapGroups" not in plan and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()

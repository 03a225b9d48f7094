import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from treeframe.llm import langid, queries
from treeframe.llm import simhash as sh

from .test_repeats import brute as repeats_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, corpus):
    """Each stage against what it should leave, on what the one before kept."""
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "simhash_dedup", "substring_dedup", "pareto_mixing", "byte_bpe"]
    df, seen = docs, {}
    for name, stage in cp.STAGES:
        before = df.collect()
        df = spark.createDataFrame(stage(spark, df, "").toArrow())
        seen[name] = (before, df.collect())
        if name != "byte_bpe":
            assert df.columns == docs.columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 72} <= {r.doc_id for r in after}
    before, after = seen["simhash_dedup"]
    texts = sorted({(r.doc_id, r.text) for r in before}, key=repr)
    raw = [t.encode() for _, t in texts]
    f = sh.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]).view(np.uint64)
    close = np.array([[np.bitwise_count(x ^ y).sum() for y in f] for x in f]) <= sh.DISTANCE
    assert len(after) == len(set(sh.local_roots(len(f), *np.nonzero(close)).tolist()))
    before, after = seen["substring_dedup"]
    cut = sum(n for *_, n in repeats_brute([(r.doc_id, r.text) for r in before], 50))
    assert sum(len(r.text.split()) for r in before) - cut == sum(len(r.text.split()) for r in after)
    before, after = seen["pareto_mixing"]
    assert len(before) == len(after) and set(after) <= set(before)
    before, after = seen["byte_bpe"]
    assert len(before) == len(after) and all(r.decodes for r in after)


@pytest.mark.parametrize("which", ["empty", "clashing"])
def test_other_tables(spark, request, which):
    df = request.getfixturevalue(which)
    n = len(df.columns)
    for _, stage in cp.STAGES:
        df = spark.createDataFrame(stage(spark, df, "").toArrow())
    assert len(df.columns) == n + 3 and (which == "empty") == df.isEmpty()


def test_run(spark):
    rows = cp.run(spark, SF).select("doc_id", "n_tokens", "decodes").collect()
    assert rows and all(r.decodes for r in rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
        names = got.column_names
        want = c.sql(queries.ORACLE_SQL[name]).to_arrow_table().select(names)
        assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))


def test_registered():
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in e.queries()} and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert langid.SAMPLE <= 5000

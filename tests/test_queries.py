"""Every query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import treeframe.queries as q

SF = os.environ.get("TREEFRAME_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows(table, names):
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, list) else v

    return sorted((tuple(plain(r[c]) for c in names) for r in table), key=repr)


@pytest.mark.parametrize("name", q.QUERIES)
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF).toArrow()
    names = sorted(got.column_names)
    if name not in q.ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.sql(q.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(want.column_names) == names
    assert rows(got.to_pylist(), names) == rows(want.to_pylist(), names)

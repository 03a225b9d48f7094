"""Trees of many texts: children of a head without a join, differences with one pass over each table."""

from collections import Counter

from pyspark.sql import functions as F

from treeframe.operators import navigate as nav
from treeframe.sources.document import node_table

TEXTS = ['{"k": 1}', None, '{"k": {"k": [1, 2]}, "j": {"k": null}}', "[]", "3", '{"k": 1.5, "k": "x"}', '{"a": [{"k": true}, {"k": 123456789012345678901}]}', "{}"]
COLUMNS = ["id", "node_id", "parent_id", "ordinal", "depth", "head", "arg_type", "long_v", "double_v", "string_v"]


def test_children_without_a_join(spark):
    """F8: as by the join, but nothing is sorted or kept."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, j string")
    for head in ("k", "Object", "List", "none"):
        want = nav.children(node_table(df, "id", "j"), "id", head).select(COLUMNS)
        got = node_table(df, "id", "j", children_of=head)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # documents of one key don't mix
    twice = spark.createDataFrame([(1, '{"k": 1}')] * 2, "id int, j string")
    assert node_table(twice, "id", "j", children_of="k").count() == 2


def test_head_children_has_no_join(spark, tmp_path):
    """F8: the query."""
    from treeframe import queries

    spark.createDataFrame([(1, '{"k": 7}'), (2, '{"j": 7}')], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["head_children"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, 2, 7)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_batches_of_nodes(spark):
    df = spark.range(30_000, numPartitions=1).select("id", F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("j"))
    rows = node_table(df, "id", "j").where("node_id = 2")
    assert rows.where("long_v = id").count() == rows.count() == 30_000
    assert node_table(df.limit(0), "id", "j").count() == 0


def test_differences_in_one_pass(spark):
    """with repeated rows, nulls, NaN and names that come twice; each table is read and shuffled once."""
    one = [(1, None), (1, None), (2, 0.5), (3, float("nan")), (4, 1.0), (4, 1.0), (4, 1.0)]
    two = [(1, None), (2, 0.5), (3, float("nan")), (4, 1.0), (5, None), (5, None)]
    a, b = (spark.createDataFrame(x, "k int, v double").toDF("a.b", "a.b") for x in (one, two))
    diff = nav.structurally_different(a, b)
    assert diff.columns == ["a.b", "a.b", "side"]
    assert Counter(tuple(r) for r in diff.collect()) == Counter({(1, None, "left"): 1, (4, 1.0, "left"): 2, (5, None, "right"): 2})
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert nav.structurally_different(a, a).isEmpty()

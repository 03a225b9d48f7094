import math

import pytest
from pyspark.sql import functions as F

from treeframe.operators import aggregates as ag
from treeframe.operators import encode as en
from treeframe.operators import navigate as nav
from treeframe.operators import order
from treeframe.operators import pages as pg
from treeframe.operators import spans as sp
from treeframe.plans.pipeline import GENERAL, Pipeline
from treeframe.plans.scan import range_scan, read_column
from treeframe.sources.sinks import write_pages


@pytest.fixture
def frame(spark):
    rows = [(i, None if i % 7 == 0 else i * 3 - 50, None if i % 5 == 0 else float("nan") if i == 3 else i / 3, None if i % 11 == 0 else "é" * (i % 13)) for i in range(300)]
    return spark.createDataFrame(rows, "k long, a int, b double, s string").repartition(3)


def test_row_index(spark, frame):
    rows = order.with_row_index(frame, "k").select("k", "row_index").collect()
    assert len(rows) == 300 and all(r.k == r.row_index for r in rows)
    assert order.with_row_index(frame.limit(0), "k").count() == 0


def test_segments(spark, frame):
    rows = order.with_row_index(frame, "k")
    before = {r.k: r.p for r in order.previous(rows, "a", "p", segment=16).collect()}
    own = {r.k: r.a for r in frame.collect()}
    assert before == {k: own.get(k - 1) for k in own}
    sums = {r.k: r.s for r in order.running_sum(rows, "k", "s", segment=16).collect()}
    assert sums == {k: k * (k + 1) // 2 for k in own}


@pytest.mark.parametrize("column,kind", [("a", pg.INT64), ("b", pg.DOUBLE), ("s", pg.BYTE_ARRAY)])
@pytest.mark.parametrize("chain", [(), ("DELTA", "RLE"), GENERAL, Pipeline.of(["RLE", "LZ77"], skip_if_larger=True)])
def test_pages_round_trip(spark, frame, tmp_path, column, kind, chain):
    pages = pg.encode_column(frame, column, "k", chain, 256)
    write_pages(pages, f"{tmp_path}/p")
    pages = spark.read.parquet(f"{tmp_path}/p")
    got = {r.row_index: r.value for r in read_column(pages, column, kind).collect()}
    want = {r.k: r[column] for r in frame.collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    meta = pages.orderBy("page_no").collect()
    at = 0
    for r in meta:
        assert r.first_row_index == at and r.n_values + r.null_count == r.n_rows and r.compressed_size == len(r.page_data)
        assert r.uncompressed_size <= 256 or r.n_values == 1
        at += r.n_rows
    assert at == 300


def test_string_pages_of_more_than_a_million_rows(spark):
    """Filled greedily from the first row to the last: 10 strings of 3 + 4 bytes in a page of 70, and no new start in between."""
    n = (1 << 20) + 25
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("abc").alias("s"))
    stats = pg.page_statistics(df, "s", "k", 70)
    assert stats.where("page <> first_row_index div 10 OR first_row_index % 10 <> 0").count() == 0
    assert stats.count() == -(-n // 10)


def test_oversize_strings(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((10, 59, 60, 61, 500, 1, 28, 28))], "k long, s string")
    stats = pg.page_statistics(df, "s", "k", 64).orderBy("page").collect()
    assert [r.n_values for r in stats] == [1, 1, 1, 1, 1, 2, 1]
    with pytest.raises(TypeError):
        pg.page_statistics(df.withColumn("d", F.current_date()), "d", "k")


def test_range_scan_prunes(spark, frame):
    pages = pg.encode_column(frame, "a", "k", ["DELTA"], 256)
    got = {(r.row_index, r.value) for r in range_scan(pages, "a", pg.INT64, 100, 200).collect()}
    assert got == {(r.k, r.a) for r in frame.where("a between 100 and 200").collect()}


def test_encodings(spark, frame):
    back = {r.row_index: r.value for r in en.delta_restore(en.delta_values(frame.select("k", (F.col("k") * F.col("k")).alias("v")), "v", "k")).collect()}
    assert back == {k: k * k for k in range(300)}
    runs = en.runs(frame.withColumn("g", F.when(F.col("k") < 100, None).otherwise((F.col("k") / 50).cast("int"))), "g", "k")
    assert [(r.first_row_index, r.length, r.value) for r in runs.orderBy("run").collect()] == [(0, 100, None), (100, 50, 2), (150, 50, 3), (200, 50, 4), (250, 50, 5)]
    assert en.runs_restore(runs).count() == 300
    codes = en.dictionary(frame, "s")
    decoded = en.dictionary_decode(en.dictionary_encode(frame, "s", codes), "code", codes)
    assert decoded.where(~F.col("s").eqNullSafe(F.col("value"))).count() == 0
    for bits, low in ((8, -100), (16, -30000), (32, -(1 << 30))):
        v = frame.select("k", (F.col("k") % 200 + low).alias("v"))
        assert {r.row_index: r.value for r in en.unpack_words(en.pack_words(v, "v", "k", bits), bits).collect()} == {k: k % 200 + low for k in range(300)}


def test_spans(spark, frame):
    assert [r.position for r in sp.gather_rows(order.with_row_index(frame, "k"), sp.index_rows(spark, [5, 0, 5])).orderBy("position").collect()] == [0, 1, 2]
    a = spark.createDataFrame([([1.5, 2.5, 3.5],)], "x array<double>")
    assert a.select(sp.gather_array("x", [2, 0, 2, 9]), sp.slice_array("x", 1), nav.child("x", 5)).first() == ([3.5, 1.5, 3.5, None], [2.5, 3.5], None)
    one = order.with_row_index(frame.select("k"), "k").select("row_index", F.col("k").alias("value"))
    assert en.coalesce_spans(one, one).agg(F.max("row_index")).first()[0] == 599
    assert nav.equal(frame, frame) and not nav.equal(frame, frame.limit(10))
    assert sp.subspan(order.with_row_index(frame, "k"), 290).count() == 10


def test_aggregates(spark, frame):
    assert ag.column_sum(frame.where("k < 0"), "b").first()[0] == 0.0
    assert ag.column_sum(frame, "a", strict_types=True).first()[0] == 0.0
    h = ag.symbol_histogram(spark.createDataFrame([("aab",), (None,), ("",)], "s string"), "s")
    assert {(r.byte, r.n) for r in h.collect()} == {(97, 2), (98, 1)}
    assert math.isclose(ag.entropy(h).first().entropy_bits, 0.918296)


def test_stream(spark, tmp_path):
    from treeframe.streaming.pages import read_paged_stream, write_paged_stream

    spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    write_paged_stream(stream, {"v": ["DELTA"]}, "id", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert read_column(read_paged_stream(spark, f"{tmp_path}/out"), "v", pg.INT64).agg(F.sum("value")).first()[0] == 9900

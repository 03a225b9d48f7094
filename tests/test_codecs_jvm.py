"""Codecs in the JVM against those in Python: the same bytes, and no page goes through Python for them."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from treeframe.functions import jvm
from treeframe.functions.codecs import CODECS
from treeframe.operators import pages as pg
from treeframe.plans.pipeline import GENERAL, Pipeline
from treeframe.plans.scan import read_column
from tests.test_codecs import CASES

#: codes of many lengths, skewed and even bytes, pages on both sides of each size at which a table grows
rng = random.Random(5)
STEEP = b"".join(bytes([i]) * n for i, n in enumerate((1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)))
MORE = [*CASES, STEEP, b"ab", b"abc" * 7000, *(bytes(rng.choice((0, 0, 0, 1, 7, 255)) for _ in range(n)) for n in (2, 63, 64, 65, 2047, 2048, 2049)), zlib.compress(rng.randbytes(2000))]


@pytest.fixture
def data(spark):
    return spark.createDataFrame([*enumerate(MORE), (-1, None)], "i int, b binary")


def through(spark, data, chain):
    assert jvm.available(spark)
    steps = F.lit(",".join(chain))
    out = data.withColumn("c", jvm.run(spark, F.col("b"), steps, True)).withColumn("d", jvm.run(spark, F.col("c"), steps, False))
    rows = {r.i: r for r in out.collect()}
    assert rows.pop(-1).c is None
    for i, r in rows.items():
        want = MORE[i]
        for name in chain:
            want = CODECS[name][0](want)
        assert bytes(r.c) == want and bytes(r.d) == MORE[i]


def test_general_chain(spark, data):
    """F1"""
    through(spark, data, GENERAL.names)
    df = data.select("i", F.base64("b").alias("s"))
    pages = pg.encode_column(df, "s", "i", GENERAL, 4096)
    back = read_column(pages, "s", pg.BYTE_ARRAY)
    assert sorted(r.value or "" for r in back.collect()) == sorted(r.s or "" for r in df.collect())
    # the codecs are between the two Python steps
    assert back._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 2
    for r in pages.collect():
        raw = GENERAL.decompress(bytes(r.page_data))
        assert r.codecs == GENERAL.names and r.compressed_size == len(r.page_data) and r.uncompressed_size == len(raw)
        assert GENERAL.compress(raw) == bytes(r.page_data)


#: F2, F3, F5, F6, and those that share the step
ALONE = ["FSE", "LZ77", "HUFFMAN", "LZW", "DELTA", "RLE", "NONE"]


@pytest.mark.parametrize("name", ALONE)
def test_single_codec(spark, data, name):
    through(spark, data, [name])


def test_functions_of_the_user(spark, data):
    """only they go to Python; steps by name are taken in the JVM, nulls stay."""
    chain = Pipeline.of(["DELTA", (zlib.compress, zlib.decompress), "HUFFMAN"])
    out = data.withColumn("c", chain.compress_column("b")).withColumn("d", chain.decompress_column("c"))
    for r in out.collect():
        assert (r.c, r.d) == (None, None) if r.i < 0 else (bytes(r.c), bytes(r.d)) == (chain.compress(MORE[r.i]), MORE[r.i])
    named = data.select(Pipeline.of(["HUFFMAN"]).compress_column("b"))
    assert "ArrowEvalPython" not in named._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="compress_page"):
        data.select(Pipeline.of(["RLE"], skip_if_larger=True).compress_column("b")).collect()


def test_made_by_the_overload_for_java(spark):
    """chosen by name alone, udf may be the overload that Spark refuses, and codecs fell back to Python."""

    class Guard:
        def __init__(self, own, path=""):
            self.own, self.path = own, path

        def __getattr__(self, name):
            path = f"{self.path}.{name}".lstrip(".")
            if path == "org.apache.spark.sql.functions.udf":
                raise AssertionError("udf by name alone")
            return Guard(getattr(self.own, name), path) if "org.apache.spark.sql.functions".startswith(path) else getattr(self.own, name)

    class Session:
        _jvm, sparkContext = Guard(spark._jvm), spark.sparkContext

    made = jvm._make(Session)
    assert made.getClass().getName().endswith("SparkUserDefinedFunction")

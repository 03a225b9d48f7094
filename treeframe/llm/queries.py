"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeframe.llm import exact_topk, langid, mixing, repeats
from treeframe.llm.ann import nearest_neighbours
from treeframe.llm.bpe import bpe_encode
from treeframe.llm.license_scan import license_scan
from treeframe.llm.simhash import simhash_dedup
from treeframe.llm.substring_dedup import broadcast_matches, substring_dedup
from treeframe.llm.suffix_array import suffix_array_dedup
from treeframe.llm.token_store import bpe_token_blocks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copies of a mixture in which sources weigh the square root of their size."""
    return mixing.copies(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")).select("doc_id", "source", "copies")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_table(spark, sf_dir, "documents"))


#: queries of the searches, against all rows
_ASKED = "vec_id % 20 = 0"


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all. Scores to six places, as sums of products differ in the last bits between engines."""
    return exact_topk.exact_topk(_table(spark, sf_dir, "embeddings"), queries=F.expr(_ASKED)).withColumn("score", F.round("score", 6))


def op6_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents' ids under the vocabulary of 50,256 tokens."""
    return bpe_token_blocks(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


#: words of a passage that counts as taken from the benchmark
_TAKEN = 13


def op7_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents that stand in the benchmark, whose automata are broadcast."""
    return broadcast_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), _TAKEN)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.expr(_ASKED))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mixing,
        op2_simhash_dedup,
        op3_byte_bpe,
        op4_suffix_array_dedup,
        op5_exact_topk,
        op6_elias_fano_tokens,
        op7_substring_dedup,
        op7_benchmark_spans,
        op8_license_scan,
        op9_kmeans_tree_ann,
        op10_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_pareto_mixing": mixing.oracle(), "op4_suffix_array_dedup": repeats.oracle(), "op5_exact_topk": exact_topk.oracle(queries=_ASKED), "op7_substring_dedup": repeats.oracle(), "op7_benchmark_spans": repeats.reference_oracle(_TAKEN)}

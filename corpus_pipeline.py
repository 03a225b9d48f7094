"""A corpus pipeline over the documents table, in five stages.

Every stage works on all that the one before kept, over whole texts, and returns the columns of
documents; the last adds the tokens. In every stage other columns may have any names (those that the
last stage adds replace columns of these names), long texts are whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeframe.llm import langid, mixing
from treeframe.llm.bpe import bpe_encode
from treeframe.llm.simhash import without_near_duplicates
from treeframe.llm.store import written
from treeframe.llm.substring_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go.

    Null and empty texts, and those of nothing but marks, have no language and go; a null lang only means
    that the document isn't among those the model is fitted on; without any lang, nothing is accepted.
    Repeated rows and ties of the score are each decided by themselves, alike.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least (doc_id, hash of text), nulls first.

    Null texts are in no group and stay, empty ones are copies of each other; of repeated rows one stays.
    """
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occurred before are cut out; documents of which nothing is left go.

    Before is by doc_id, nulls first, and then by hash of the text. Null texts stay; repeated rows lose the same.
    """
    return remove_repeats(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as there were, in which a source weighs the square root of its size; some documents repeat.

    A null source is one of its own; documents whose n_chars is null or 0 go; ties go to the lower doc_id.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens, and decodes: whether the ids gave the text back.

    Null texts have nulls, empty ones no tokens; repeated rows are encoded each.
    """
    return bpe_encode(docs, docs.columns)


STAGES = [("language_id", language_id), ("simhash_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pareto_mixing", mixing_to_weights), ("byte_bpe", tokens)]

#: language ID, near-dedup and BPE aren't expressible in SQL; they are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

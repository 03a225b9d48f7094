"""Encodings of values, as plain DataFrame operations with exact inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeframe.operators.order import previous, running_sum, with_row_index


def delta_values(df: DataFrame, column: str, order_by: str | list[str]) -> DataFrame:
    """row_index and delta: the first value, then differences to the row before."""
    rows = with_row_index(df, order_by).select("row_index", F.col(column).alias("value"))
    return previous(rows, "value", "before").select("row_index", (F.col("value") - F.coalesce("before", F.lit(0))).alias("delta"))


def delta_restore(deltas: DataFrame) -> DataFrame:
    return running_sum(deltas, "delta", "value").select("row_index", F.col("value").cast("long").alias("value"))


def runs(df: DataFrame, column: str, order_by: str | list[str]) -> DataFrame:
    """run, first_row_index, length and value of each run of equal values; nulls are equal."""
    rows = with_row_index(df, order_by).select("row_index", F.col(column).alias("value"))
    marked = previous(rows, "value", "before").withColumn("begins", F.when((F.col("row_index") == 0) | ~F.col("value").eqNullSafe(F.col("before")), 1).otherwise(0))
    numbered = running_sum(marked, "begins", "run")
    return numbered.groupBy("run").agg(F.min("row_index").alias("first_row_index"), F.count("*").alias("length"), F.first("value").alias("value")).withColumn("run", F.col("run").cast("long") - 1)


def runs_restore(run_rows: DataFrame) -> DataFrame:
    return run_rows.select(F.explode(F.sequence("first_row_index", F.col("first_row_index") + F.col("length") - 1)).alias("row_index"), "value")


def rle_size(run_rows: DataFrame) -> DataFrame:
    """Bytes of the runs as pairs of a length up to 255 and a byte."""
    return run_rows.agg(F.sum(F.expr("2 * ((length + 254) div 255)")).cast("long").alias("rle_bytes"), F.count("*").alias("n_runs"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """code and value of the distinct values but null, in their order."""
    distinct = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_row_index(distinct, "value", "code").select("code", "value")


def dictionary_encode(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """The rows with the code of the column's value; Spark broadcasts the dictionary if it is small."""
    return df.join(codes.select(F.col("value").alias("tf_value"), F.col("code").alias(name)), F.col(column) == F.col("tf_value"), "left").drop("tf_value")


def dictionary_decode(df: DataFrame, code: str, codes: DataFrame, name: str = "value") -> DataFrame:
    return df.join(codes.select(F.col("code").alias("tf_code"), F.col("value").alias(name)), F.col(code) == F.col("tf_code"), "left").drop("tf_code")


def code_bytes(distinct: Column) -> Column:
    """Bytes of a code: 1 up to 256 values, 2 up to 65,536, else 4."""
    return F.when(distinct <= 256, 1).when(distinct <= 65_536, 2).otherwise(4)


def dictionary_benefit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_values, n_distinct, code_bytes, and whether a dictionary pays: distinct < n / 2 and < 255.

    One pass: each column's values are counted distinct together.
    """
    stats = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)])).alias("r")
    out = stats.select(rows).select("r.*")
    return out.withColumns({"code_bytes": code_bytes(F.col("n_distinct")).cast("long"), "pays": (F.col("n_distinct") * 2 < F.col("n_values")) & (F.col("n_distinct") < 255)})


def intern_savings(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, total_bytes, interned_bytes, saved_bytes if equal strings were stored once."""
    long_form = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("r")).select("r.*").where(F.col("value").isNotNull())
    once = long_form.groupBy("column_name", "value").agg(F.count("*").alias("n")).withColumn("b", F.octet_length("value").cast("long"))
    return once.groupBy("column_name").agg(F.sum(F.col("n") * F.col("b")).alias("total_bytes"), F.sum("b").alias("interned_bytes"), F.sum((F.col("n") - 1) * F.col("b")).alias("saved_bytes"))


def bit_width(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, max_value, bits: the width that holds 0 .. the largest value."""
    most = df.agg(*[F.max(c).cast("long").alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("max_value")) for i, c in enumerate(columns)])).alias("r")
    return most.select(rows).select("r.*").withColumn("bits", F.length(F.bin("max_value")).cast("long"))


def pack_words(df: DataFrame, column: str, order_by: str | list[str], bits: int) -> DataFrame:
    """word_no, word, n: 64 / bits values to a word of 64 bits, the first in the highest field.

    Values are cut to their field, so that negative ones stay in it; the word is signed.
    """
    if bits not in (8, 16, 32):
        raise ValueError("a field has 8, 16 or 32 bits")
    per = 64 // bits
    rows = with_row_index(df, order_by).select("row_index", F.col(column).cast("long").alias("v"))
    field = F.expr(f"shiftleft(v & {(1 << bits) - 1}L, cast({64 - bits} - {bits} * (row_index % {per}) as int))")
    return rows.groupBy(F.expr(f"row_index div {per}").alias("word_no")).agg(F.bit_or(field).alias("word"), F.count("*").alias("n"))


def unpack_words(words: DataFrame, bits: int, signed: bool = True) -> DataFrame:
    """row_index and value."""
    per = 64 // bits
    out = words.select("word_no", "word", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    raw = F.expr(f"shiftrightunsigned(word, {64 - bits} - {bits} * i) & {(1 << bits) - 1}L")
    value = F.when(raw >= (1 << (bits - 1)), raw - (1 << bits)).otherwise(raw) if signed else raw
    return out.select((F.col("word_no") * per + F.col("i")).alias("row_index"), value.alias("value"))


def dictionary_words(df: DataFrame, column: str, order_by: str | list[str]) -> DataFrame:
    """word_no, word, n: the codes of a column in words of 64 bits, in fields of 1, 2 or 4 bytes as the dictionary needs; nulls take the code after the last."""
    codes = dictionary(df, column)
    n = codes.count()
    coded = dictionary_encode(df, column, codes, "tf_code").withColumn("tf_code", F.coalesce("tf_code", F.lit(n)))
    return pack_words(coded, "tf_code", order_by, 8 if n < 256 else 16 if n < 65_536 else 32)


def type_runs(node_rows: DataFrame, key: str, least: int = 5, rle: bool = True) -> DataFrame:
    """Runs of equal arg_type among the children of a node, in order: key, parent_id, first, arg_type, length, encoded.

    Runs of `least` and more are stored as one flagged type and a length; without rle none is.
    """
    order = Window.partitionBy(key, "parent_id").orderBy("ordinal")
    begins = F.when(F.lag("arg_type").over(order).eqNullSafe(F.col("arg_type")), 0).otherwise(1)
    numbered = node_rows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    return numbered.groupBy(key, "parent_id", "run").agg(F.min("ordinal").alias("first"), F.first("arg_type").alias("arg_type"), F.count("*").alias("length")).withColumn("encoded", F.lit(rle) & (F.col("length") >= least)).drop("run")


def coalesce_spans(*spans: DataFrame) -> DataFrame:
    """One span of several of the same type: frames of (row_index, value) one after the other."""
    kinds = {s.schema["value"].dataType for s in spans}
    if len(kinds) != 1:
        raise TypeError("spans differ in type")
    out, offset = None, 0
    for s in spans:
        moved = s.select((F.col("row_index") + offset).alias("row_index"), "value")
        out = moved if out is None else out.unionByName(moved)
        offset += s.count()
    return out

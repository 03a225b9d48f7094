"""Row numbers in the order of some columns, without a single partition for all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treeframe-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def with_row_index(df: DataFrame, order_by: str | list[str], name: str = "row_index") -> DataFrame:
    """The rows with their number from 0, a long, in the order of the columns, which must not tie.

    Tables of any size are sorted by range partitions and written; each partition numbers its rows, and the
    counts of those before (one number a partition) are added.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    path = f"{scratch(df.sparkSession)}/ordered-{uuid.uuid4().hex}"
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.withColumns({"tf_at": F.monotonically_increasing_id()}).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    part = F.shiftrightunsigned("tf_at", 33)
    counts = stored.groupBy(part.alias("tf_part")).agg(F.count("*").alias("n"))
    before = counts.select("tf_part", F.coalesce(F.sum("n").over(Window.orderBy("tf_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tf_before"))
    joined = stored.join(F.broadcast(before), part == F.col("tf_part"))
    return joined.withColumn(name, (F.col("tf_before") + F.col("tf_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("tf_at", "tf_part", "tf_before")


#: rows of a segment: what windows in row order see at once
SEGMENT = 1 << 18


def previous(df: DataFrame, column: str, name: str, index: str = "row_index", segment: int = SEGMENT) -> DataFrame:
    """The column's value in the row before, null in the first; windows are by segment of rows."""
    seg = F.expr(f"`{index}` div {segment}")
    inside = F.lag(F.struct(column)).over(Window.partitionBy("tf_seg").orderBy(index))
    last = df.groupBy(seg.alias("tf_of")).agg(F.max_by(F.struct(F.col(column)), F.col(index)).alias("tf_last")).select((F.col("tf_of") + 1).alias("tf_of"), "tf_last")
    joined = df.withColumn("tf_seg", seg).withColumn("tf_in", inside).join(last, F.col("tf_seg") == F.col("tf_of"), "left")
    return joined.withColumn(name, F.coalesce("tf_in", F.when(F.col(index) % segment == 0, F.col("tf_last")))[column]).drop("tf_seg", "tf_in", "tf_of", "tf_last")


def running_sum(df: DataFrame, column: str, name: str, index: str = "row_index", segment: int = SEGMENT) -> DataFrame:
    """The sum of the column up to each row; by segment, with the sums of the segments before."""
    seg = F.expr(f"`{index}` div {segment}")
    inside = F.sum(column).over(Window.partitionBy("tf_seg").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    sums = df.groupBy(seg.alias("tf_of")).agg(F.sum(column).alias("tf_s"))
    before = sums.select("tf_of", F.sum("tf_s").over(Window.orderBy("tf_of").rowsBetween(Window.unboundedPreceding, -1)).alias("tf_before"))
    joined = df.withColumn("tf_seg", seg).withColumn("tf_in", inside).join(before, F.col("tf_seg") == F.col("tf_of"), "left")
    return joined.withColumn(name, F.col("tf_in") + F.coalesce(F.col("tf_before"), F.lit(0))).drop("tf_seg", "tf_in", "tf_of", "tf_before", "tf_s")

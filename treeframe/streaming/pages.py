"""Pages of a stream: each micro-batch is paged, encoded and appended as any table is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeframe.operators.pages import PAGE_BYTES, encode_table


def write_paged_stream(stream: DataFrame, pipelines: Mapping[str, Sequence[str]], order_by: str | list[str], path: str, checkpoint: str, page_bytes: int = PAGE_BYTES, **trigger) -> StreamingQuery:
    """Appends pages with their batch_id; first_row_index counts within a batch. A batch that is run again replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        pages = encode_table(batch, pipelines, order_by, page_bytes)
        pages.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_paged_stream(spark, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(path)

"""Incremental runs: new page files are planned and published once.

A file-source stream with an available-now trigger hands each new file to one micro-batch;
its checkpoint remembers what was read, so running again with nothing new does no work.
Batches write by overwriting their own batch's folder, which makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_key long, page_idx int, text string, method string"


def run_incremental(
    spark: SparkSession,
    source: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    schema: str = PAGES,
    files_per_batch: int = 1000,
) -> int:
    """Pass all new rows of the parquet folder ``source`` to ``handle``; batches run."""
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return len([p for p in stream.recentProgress if p["numInputRows"]])


def section_writer(target: str, plan: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler that plans a batch's documents and writes them under their batch number."""

    def handle(batch: DataFrame, number: int) -> None:
        plan(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return handle

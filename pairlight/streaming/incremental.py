"""The six-metric summary over arriving result rows (the reference itself only runs finite batches)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairlight.operators.summaries import from_counts, incremental_counts


def start(stream: DataFrame, keys: Sequence[str], target: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's sums under ``target/batch=<id>``; a batch that is run again overwrites its own part, so
    every row counts once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        incremental_counts(batch, keys).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, keys: Sequence[str], target: str) -> DataFrame:
    return from_counts(spark.read.parquet(target), keys)

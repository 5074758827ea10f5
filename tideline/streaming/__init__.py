"""Keyed upserts from a stream into a versioned parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..keyspec import KeySpec
from ..operators.edit import collapse, upsert
from ..storage import remove


def upsert_stream(changes: DataFrame, keys: KeySpec, seq: Column, path: str, checkpoint: str, versions: int = 8) -> StreamingQuery:
    """Each micro-batch writes version ``epoch`` of the table from version ``epoch - 1``.

    A replayed batch overwrites its own version with the same rows, so the result is exactly once. The last ``versions`` versions, two at least, stay.
    """
    if versions < 2:
        raise ValueError("a replayed batch reads the version before its own")

    def apply(batch: DataFrame, epoch: int) -> None:
        new = collapse(batch, keys, seq)
        if epoch:
            new = upsert(batch.sparkSession.read.parquet(f"{path}/v={epoch - 1}"), keys, new)
        new.write.mode("overwrite").parquet(f"{path}/v={epoch}")
        if epoch >= versions:
            remove(batch.sparkSession, f"{path}/v={epoch - versions}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={epoch}")

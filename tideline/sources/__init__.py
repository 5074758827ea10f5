"""Parquet, the only source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..keyspec import KeySpec
from ..table import SortedTable


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, path: str, keys: KeySpec | str) -> SortedTable:
    return SortedTable(spark.read.parquet(path), keys)


def write_table(table: SortedTable, path: str, files: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that row-group statistics prune range reads."""
    df, order = table.df, table.keys.order(table.df)
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)

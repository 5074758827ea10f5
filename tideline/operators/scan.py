"""Ordered scans: ranges, counters, early stop, seeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keyspec import KeySpec
from ..storage import materialize, spread


def get_range(df: DataFrame, keys: KeySpec, low, high, include_high: bool = False, max_length: int | None = None) -> DataFrame:
    """Rows of the range in key order, at most ``max_length`` of them."""
    out = df.filter(keys.within(df, low, high, include_high)).orderBy(*keys.order(df))
    return out if max_length is None else out.limit(max_length)


def count_range(df: DataFrame, keys: KeySpec, low, high, include_high: bool = False) -> DataFrame:
    return df.filter(keys.within(df, low, high, include_high)).agg(F.count(F.lit(1)).alias("n"))


def global_counter(df: DataFrame, keys: KeySpec, name: str, initial: int = 0, partitions: int | None = None) -> DataFrame:
    """A dense 0-based position in key order without gathering the rows in one task.

    Range-partition, write the partitions once so that their bounds stay fixed, number
    each one on its own, and shift by the rows in the partitions before it. Only one
    count for each partition is ever brought together.
    """
    n = partitions or spread(df)
    dealt = df.repartitionByRange(n, *keys.order(df)).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "counter")
    sums = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys.order(df)))
    out = dealt.withColumn("_local", local).join(F.broadcast(starts), "_part")  # one row for each partition
    return out.select(*df.columns, (F.col("_start") + F.col("_local") - 1 + initial).cast("bigint").alias(name))


def until_stop(df: DataFrame, rows: DataFrame, keys: KeySpec, stop: Column) -> tuple[DataFrame, Column]:
    """df with further columns, and whether a row's key is at or before the first of ``rows``, in key order, where ``stop`` is true.

    The one row that stops is broadcast; nothing is shuffled, sorted or gathered but a top 1.
    """
    held = [F.col(n).alias(f"_stop_{n}") for n in keys.names]
    first = rows.filter(stop).orderBy(*keys.order(rows)).limit(1).select(*held, F.lit(True).alias("_stops"))
    bounds = [F.col(f"_stop_{n}") for n in keys.names]
    wide = df.join(F.broadcast(first), F.lit(True), "left")
    return wide, F.col("_stops").isNull() | keys.compare(df, "<=", tuple(bounds) if len(bounds) > 1 else bounds[0])


def stop_at(df: DataFrame, keys: KeySpec, stop: Column) -> DataFrame:
    """Rows up to and including the first, in key order, where ``stop`` is true."""
    wide, visited = until_stop(df, df, keys, stop)
    return wide.filter(visited).select(*df.columns)


def for_range(df: DataFrame, keys: KeySpec, low, high, include_high: bool, initial: int = 0, stop: Column | None = None) -> DataFrame:
    """The visited rows with their ``counter``."""
    rows = df.filter(keys.within(df, low, high, include_high))
    if stop is not None:
        rows = stop_at(rows, keys, stop)
    return global_counter(rows, keys, "counter", initial)


def find_first(df: DataFrame, keys: KeySpec, predicate: Column) -> DataFrame:
    return df.filter(predicate).orderBy(*keys.order(df)).limit(1)


def entries(df: DataFrame, keys: KeySpec, lowest=None) -> DataFrame:
    return df.filter(keys.within(df, lowest)).orderBy(*keys.order(df))


def entries_reversed(df: DataFrame, keys: KeySpec, highest=None, skip_highest: bool = False) -> DataFrame:
    """Descending from the last key <= highest (< if skip_highest, which needs a seek key)."""
    rows = df if highest is None else df.filter(keys.compare(df, "<" if skip_highest else "<=", highest))
    return rows.orderBy(*keys.order(df, reverse=True))


def range_join(df: DataFrame, keys: KeySpec, ranges: DataFrame, low: str, high: str, width: float, include_high: bool = False) -> DataFrame:
    """Every (range, row) with low <= key < high, for many ranges of a numeric key.

    Keys and ranges meet on cells of ``width``, so that this is an equi-join instead of a nested loop.
    """
    key = keys.names[0]
    cell = lambda c: F.floor(c / F.lit(width))
    cut = ranges.filter(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    inside = (F.col(key) >= F.col(low)) & ((F.col(key) <= F.col(high)) if include_high else (F.col(key) < F.col(high)))
    return cut.join(df.withColumn("_cell", cell(F.col(key))), "_cell").filter(inside).drop("_cell")

"""Point and batch lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keyspec import KeySpec


def get(df: DataFrame, keys: KeySpec, key, default=None):
    """The row of ``key``, else ``default`` wherever the key would stand."""
    found = df.filter(keys.compare(df, "==", key)).take(1)
    return found[0] if found else default


def has(df: DataFrame, keys: KeySpec, key) -> bool:
    """Presence is the row itself; a NULL value is present."""
    return bool(df.filter(keys.compare(df, "==", key)).select(F.lit(1)).take(1))


def get_batch(df: DataFrame, keys: KeySpec, probes: DataFrame, value: str, default=None) -> DataFrame:
    """Each probe with ``value`` and ``found``; a present NULL stays NULL, an absent key gets the default."""
    kind = df.schema[value].dataType
    side = df.select(*keys.names, F.col(value).alias("_value"), F.lit(True).alias("_found")).alias("t")
    out = probes.alias("p").join(side, keys.same("p", "t"), "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return out.select("p.*", F.when(found, F.col("_value")).otherwise(F.lit(default).cast(kind)).alias(value), found.alias("found"))


def has_batch(df: DataFrame, keys: KeySpec, probes: DataFrame) -> DataFrame:
    return present(probes, keys, df)


def missing(df: DataFrame, keys: KeySpec, probes: DataFrame) -> DataFrame:
    return minus(probes, keys, df)


def present(df: DataFrame, keys: KeySpec, others: DataFrame) -> DataFrame:
    """Rows of df whose key is among others."""
    return df.alias("t").join(others.select(*keys.names).alias("o"), keys.same("t", "o"), "left_semi")


def minus(df: DataFrame, keys: KeySpec, others: DataFrame) -> DataFrame:
    return df.alias("t").join(others.select(*keys.names).alias("o"), keys.same("t", "o"), "left_anti")


def edge(df: DataFrame, keys: KeySpec, highest: bool = False) -> DataFrame:
    """The lowest (highest) row; no row for an empty table. A top-1 per partition, then of those."""
    return df.orderBy(*keys.order(df, reverse=highest)).limit(1)

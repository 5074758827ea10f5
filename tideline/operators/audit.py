"""Integrity audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keyspec import KeySpec


class InvalidTable(AssertionError):
    """The frame breaks an invariant of a sorted table."""


def check(fact: bool, *said: object) -> None:
    if not fact:
        raise InvalidTable("assertion failed: " + " ".join(map(str, said)))


def audit(df: DataFrame, keys: KeySpec) -> DataFrame:
    """One row: size, keys seen more than once, rows with a NULL in the key."""
    null = F.lit(False)
    for n in keys.names:
        null = null | F.col(n).isNull()
    by_key = df.groupBy(*keys.names).agg(F.count(F.lit(1)).alias("_n"), F.max(null).alias("_null"))
    zero = F.lit(0)
    return by_key.agg(F.coalesce(F.sum("_n"), zero).alias("size"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeated_keys"), F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n")).otherwise(zero)), zero).alias("null_keys"))


def check_valid(df: DataFrame, keys: KeySpec, expected_size: int | None = None) -> None:
    found = audit(df, keys).first()
    check(found["repeated_keys"] == 0, found["repeated_keys"], "keys stand more than once")
    check(keys.allow_null or found["null_keys"] == 0, found["null_keys"], "rows have a NULL key")
    check(expected_size is None or found["size"] == expected_size, "size is", found["size"], "not", expected_size)

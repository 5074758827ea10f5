"""Sort-key columns for values that have no single Spark order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed_key(boolean: Column | None = None, number: Column | None = None, when: Column | None = None, text: Column | None = None) -> Column:
    """One sortable struct for a key that may be a boolean, number, timestamp or text.

    Order: booleans, NaN, numbers, NULL, timestamps, texts. Give each kind as its own column, NULL where it isn't of that kind.
    """
    b = F.lit(None).cast("boolean") if boolean is None else boolean
    n = F.lit(None).cast("double") if number is None else number.cast("double")
    t = F.lit(None).cast("timestamp") if when is None else when
    s = F.lit(None).cast("string") if text is None else text
    rank = F.when(b.isNotNull(), 0).when(F.isnan(n), 1).when(n.isNotNull(), 2).when(t.isNotNull(), 4).when(s.isNotNull(), 5).otherwise(3)
    return F.struct(rank.alias("rank"), b.alias("b"), n.alias("n"), t.alias("t"), s.alias("s"))


def joined_text_key(array: Column) -> Column:
    """Orders arrays by their comma-joined text instead of element by element."""
    return F.array_join(array.cast("array<string>"), ",", "")


def null_as_zero(x: Column) -> Column:
    """The plain numeric order in which NULL counts as 0."""
    return F.coalesce(x, F.lit(0))

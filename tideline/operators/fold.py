"""Folds in key order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keyspec import KeySpec


def _check(keys: KeySpec) -> None:
    if not all(k.ascending for k in keys.keys):
        raise ValueError("ordered folds take ascending keys; negate or invert the column first")


def ordered(
    df: DataFrame, keys: KeySpec, initial: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None,
    by: list[str],
) -> DataFrame:
    """``merge(acc, row)`` over the rows of each ``by`` group in key order; an empty table gives ``initial``.

    A fold that depends on order holds its group in one row, so give ``by`` at scale; commutative
    folds belong in ``reduce``, which combines partially.
    """
    _check(keys)
    rest = [c for c in df.columns if c not in keys.names]
    rows = F.array_sort(F.collect_list(F.struct(*keys.names, *rest)))
    grouped = df.groupBy(*by).agg(rows.alias("_rows"))
    out = F.aggregate("_rows", initial, merge, finish) if finish else F.aggregate("_rows", initial, merge)
    return grouped.select(*by, out.alias("value"))


def to_string(df: DataFrame, keys: KeySpec, values: list[str]) -> DataFrame:
    """The flattened ``k,v,k,v`` text; NULL shows as empty."""
    _check(keys)
    text = lambda x: F.concat_ws(",", *[F.coalesce(x[c].cast("string"), F.lit("")) for c in [*keys.names, *values]])
    rows = F.array_sort(F.collect_list(F.struct(*keys.names, *values)))
    return df.agg(F.array_join(F.transform(rows, text), ",").alias("text"))

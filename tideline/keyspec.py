"""Key order: which columns make the key, in which direction, and where NULL and NaN stand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)
#: Types whose NULLs sort after the values; other types put NULL before them.
_NULL_LAST = (T.BooleanType, T.NumericType)


@dataclass(frozen=True)
class Key:
    """One key column. ``nulls``: "first", "last" or None for the type's default place."""

    name: str
    ascending: bool = True
    nulls: str | None = None


@dataclass(frozen=True)
class KeySpec:
    """The order of a table; two specs are the same order iff they are equal.

    Floats sort NaN below -Infinity, and -0.0 equals 0.0. Arrays compare element by
    element. Strings compare by UTF-8 bytes. NULL keys are refused unless ``allow_null``.
    """

    keys: tuple[Key, ...]
    allow_null: bool = False

    @staticmethod
    def of(*keys: str | Key, allow_null: bool = False) -> KeySpec:
        return KeySpec(tuple(k if isinstance(k, Key) else Key(k) for k in keys), allow_null)

    @property
    def names(self) -> list[str]:
        return [k.name for k in self.keys]

    def validate(self, df: DataFrame) -> None:
        """Reject missing columns and types without an order."""
        if not self.keys:
            raise ValueError("a key needs at least one column")
        for k in self.keys:
            if k.name not in df.columns:
                raise ValueError(f"key column {k.name} is missing")
            if isinstance(df.schema[k.name].dataType, (T.MapType, T.VariantType, T.CalendarIntervalType)):
                raise TypeError(f"key column {k.name} has no order")

    def _parts(self, df: DataFrame, value=None) -> list[tuple[Column, bool, bool]]:
        """(expression, ascending, nulls first) for each sort expression."""
        out: list[tuple[Column, bool, bool]] = []
        for i, k in enumerate(self.keys):
            kind = df.schema[k.name].dataType
            x = F.col(k.name) if value is None else F.lit(value[i]).cast(kind)
            first = (not isinstance(kind, _NULL_LAST)) if k.nulls is None else k.nulls == "first"
            if k.nulls is None and not k.ascending:
                first = not first
            if isinstance(kind, _FLOATS):
                out.append((F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(0)).otherwise(F.lit(1)), k.ascending, first))
            out.append((x, k.ascending, first))
        return out

    def order(self, df: DataFrame, reverse: bool = False) -> list[Column]:
        out = []
        for x, up, first in self._parts(df):
            if reverse:
                up, first = not up, not first
            out.append((x.asc_nulls_first() if first else x.asc_nulls_last()) if up else (x.desc_nulls_first() if first else x.desc_nulls_last()))
        return out

    def _values(self, bound) -> Sequence:
        values = bound if isinstance(bound, (tuple, list)) and len(self.keys) > 1 else [bound]
        if len(values) != len(self.keys):
            raise ValueError("a bound gives one value for each key column")
        return values

    def compare(self, df: DataFrame, op: str, bound) -> Column:
        """``key op bound`` in this order; op is one of < <= > >= ==.

        A single key without NaN becomes a bare comparison, which reaches the scan as a pushed filter.
        """
        values = self._values(bound)
        if op == "==":
            out = F.lit(True)
            for k, v in zip(self.keys, values, strict=True):
                out = out & F.col(k.name).eqNullSafe(F.lit(v).cast(df.schema[k.name].dataType))
            return out
        plain = not self.allow_null and len(self.keys) == 1
        if plain and not isinstance(df.schema[self.keys[0].name].dataType, _FLOATS):
            k = self.keys[0]
            x, v = F.col(k.name), F.lit(values[0]).cast(df.schema[k.name].dataType)
            if not k.ascending:
                op = op.translate(str.maketrans("<>", "><"))
            return {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]
        strict, wants_less = "=" not in op, op[0] == "<"
        out = F.lit(not strict)
        mine, theirs = self._parts(df), self._parts(df, values)
        for (x, up, first), (y, _, _) in reversed(list(zip(mine, theirs, strict=True))):
            less = (x < y) if up else (x > y)
            more = (x > y) if up else (x < y)
            null_less = x.isNull() & y.isNotNull() if first else x.isNotNull() & y.isNull()
            null_more = x.isNotNull() & y.isNull() if first else x.isNull() & y.isNotNull()
            before = F.coalesce(less, F.lit(False)) | null_less
            after = F.coalesce(more, F.lit(False)) | null_more
            out = F.when(before, F.lit(wants_less)).when(after, F.lit(not wants_less)).otherwise(out)
        return out

    def within(self, df: DataFrame, low=None, high=None, include_high: bool = False) -> Column:
        """``low <= key < high`` (``<= high`` if include_high); a bound of None is open. Inverted bounds hold nothing."""
        out = F.lit(True)
        if low is not None:
            out = self.compare(df, ">=", low)
        if high is not None:
            out = out & self.compare(df, "<=" if include_high else "<", high)
        return out

    def struct(self) -> Column:
        return F.struct(*self.names)

    def same(self, left: str, right: str) -> Column:
        """Null-safe key equality of two aliased frames."""
        out = None
        for n in self.names:
            c = F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
            out = c if out is None else out & c
        return out

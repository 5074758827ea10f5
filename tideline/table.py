"""SortedTable: an immutable, ordered, uniquely keyed view of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .keyspec import KeySpec
from .operators import audit, diff, edit, fold, lookup, neighbor, scan
from .storage import materialize


class FrozenError(RuntimeError):
    """A frozen table refuses every method that stands for a mutation."""


class SortedTable:
    """Each method returns a DataFrame, a scalar or a new table; the underlying frame never changes.

    Methods named like mutations (set, delete_range, edit_range ...) return the edited
    table and raise on a frozen one; with_*/without_* forms work on frozen tables too.
    """

    def __init__(self, df: DataFrame, keys: KeySpec | str, *, frozen: bool = False):
        self.keys = KeySpec.of(keys) if isinstance(keys, str) else keys
        self.keys.validate(df)
        self.df = df
        self._frozen = frozen

    # construction ---------------------------------------------------------
    @classmethod
    def from_pairs(cls, pairs: DataFrame, keys: KeySpec | str, seq: list[Column] | Column, overwrite: bool = True) -> SortedTable:
        """Bulk build: of rows with one key the last by ``seq`` stays (the first if not overwrite)."""
        spec = KeySpec.of(keys) if isinstance(keys, str) else keys
        return cls(edit.collapse(pairs, spec, seq, last=overwrite), spec)

    @classmethod
    def empty(cls, spark: SparkSession, schema: T.StructType, keys: KeySpec | str) -> SortedTable:
        """The frozen empty table."""
        return cls(spark.createDataFrame([], schema), keys, frozen=True)

    def _new(self, df: DataFrame) -> SortedTable:
        return SortedTable(df, self.keys)

    @property
    def value_cols(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys.names]

    # metadata and point lookups -------------------------------------------
    def size(self) -> int:
        return self.df.count()

    length = size

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def get(self, key, default=None):
        return lookup.get(self.df, self.keys, key, default)

    def has(self, key) -> bool:
        return lookup.has(self.df, self.keys, key)

    def get_batch(self, probes: DataFrame, value: str, default=None) -> DataFrame:
        return lookup.get_batch(self.df, self.keys, probes, value, default)

    def has_batch(self, probes: DataFrame) -> DataFrame:
        return lookup.has_batch(self.df, self.keys, probes)

    def missing(self, probes: DataFrame) -> DataFrame:
        return lookup.missing(self.df, self.keys, probes)

    def min_key(self) -> DataFrame:
        return lookup.edge(self.df, self.keys).select(*self.keys.names)

    def max_key(self) -> DataFrame:
        return lookup.edge(self.df, self.keys, highest=True).select(*self.keys.names)

    def min_pair(self) -> DataFrame:
        return lookup.edge(self.df, self.keys)

    def max_pair(self) -> DataFrame:
        return lookup.edge(self.df, self.keys, highest=True)

    # ordered scans ----------------------------------------------------------
    def get_range(self, low, high, include_high: bool = False, max_length: int | None = None) -> DataFrame:
        return scan.get_range(self.df, self.keys, low, high, include_high, max_length)

    def count_range(self, low, high, include_high: bool = False) -> DataFrame:
        return scan.count_range(self.df, self.keys, low, high, include_high)

    def for_range(self, low, high, include_high: bool = False, initial: int = 0, stop: Column | None = None) -> DataFrame:
        return scan.for_range(self.df, self.keys, low, high, include_high, initial, stop)

    def for_each(self, initial: int = 0, stop: Column | None = None) -> DataFrame:
        return scan.for_range(self.df, self.keys, None, None, False, initial, stop)

    for_each_pair = for_each

    def find_first(self, predicate: Column) -> DataFrame:
        return scan.find_first(self.df, self.keys, predicate)

    def entries(self, lowest=None) -> DataFrame:
        return scan.entries(self.df, self.keys, lowest)

    def entries_reversed(self, highest=None, skip_highest: bool = False) -> DataFrame:
        return scan.entries_reversed(self.df, self.keys, highest, skip_highest)

    def key_rows(self, first=None) -> DataFrame:
        return self.entries(first).select(*self.keys.names)

    def value_rows(self, first=None) -> DataFrame:
        return self.entries(first).select(*self.value_cols)

    def to_array(self, max_length: int | None = None) -> DataFrame:
        rows = self.entries()
        return rows if max_length is None else rows.limit(max_length)

    def keys_array(self) -> DataFrame:
        return self.key_rows()

    def values_array(self) -> DataFrame:
        return self.value_rows()

    def to_string(self) -> DataFrame:
        return fold.to_string(self.df, self.keys, self.value_cols)

    def as_set(self) -> DataFrame:
        return self.df.select(*self.keys.names)

    def range_join(self, ranges: DataFrame, low: str, high: str, width: float, include_high: bool = False) -> DataFrame:
        return scan.range_join(self.df, self.keys, ranges, low, high, width, include_high)

    def __iter__(self) -> Iterator[Row]:
        return self.entries().toLocalIterator()

    # nearest neighbours ------------------------------------------------------
    def next_lower_pair(self, key=None) -> DataFrame:
        return neighbor.nearest(self.df, self.keys, key, "lower", strict=True)

    def next_higher_pair(self, key=None) -> DataFrame:
        return neighbor.nearest(self.df, self.keys, key, "higher", strict=True)

    def next_lower_key(self, key=None) -> DataFrame:
        return self.next_lower_pair(key).select(*self.keys.names)

    def next_higher_key(self, key=None) -> DataFrame:
        return self.next_higher_pair(key).select(*self.keys.names)

    def get_pair_or_next_lower(self, key) -> DataFrame:
        return neighbor.nearest(self.df, self.keys, key, "lower", strict=False)

    def get_pair_or_next_higher(self, key) -> DataFrame:
        return neighbor.nearest(self.df, self.keys, key, "higher", strict=False)

    def asof(
        self, probes: DataFrame, on: str, probe_on: str, by: list[str], values: list[str], direction: str, strict: bool,
        skewed: bool = False,
    ) -> DataFrame:
        """Batch neighbour lookup in this table's key order; ``by`` empty means one global order.

        ``skewed`` is for a ``by`` of which one value holds much of the rows: those are then swept by many tasks. NULLs and clashing names:
        see neighbor.Sweep.
        """
        sweep = neighbor.asof_by if by and not skewed else neighbor.asof_global
        return sweep(self.df, probes, self.keys, on, probe_on, by, values, direction, strict)

    # edits ----------------------------------------------------------------
    def _mutable(self) -> None:
        if self._frozen:
            raise FrozenError("the table is frozen")

    def set_pairs(self, pairs: DataFrame, seq: list[Column] | Column, overwrite: bool = True) -> SortedTable:
        self._mutable()
        return self.with_pairs(pairs, seq, overwrite)

    set_range = set_pairs

    def set(self, row: dict, overwrite: bool = True) -> SortedTable:
        self._mutable()
        return self.with_(row, overwrite)

    add = set

    def set_if_not_present(self, row: dict) -> SortedTable:
        return self.set(row, overwrite=False)

    def _key_of(self, row: dict):
        values = tuple(row.get(n) for n in self.keys.names)
        return values if len(values) > 1 else values[0]

    def set_told(self, row: dict, overwrite: bool = True) -> tuple[SortedTable, bool]:
        """set(), and whether the key is new."""
        return self.set(row, overwrite), not self.has(self._key_of(row))

    def delete_told(self, key) -> tuple[SortedTable, bool]:
        """delete(), and whether the key was there."""
        return self.delete(key), self.has(key)

    def change_told(self, row: dict) -> tuple[SortedTable, bool]:
        """change_if_present() of one key, and whether it is there."""
        there = self.has(self._key_of(row))
        return (self.set(row) if there else self.clone()), there

    def change_if_present(self, changes: DataFrame) -> SortedTable:
        self._mutable()
        return self._new(edit.change_if_present(self.df, self.keys, changes))

    def delete(self, key) -> SortedTable:
        self._mutable()
        return self.without(key)

    def delete_keys(self, keys: DataFrame) -> SortedTable:
        self._mutable()
        return self.without_keys(keys)

    def delete_range(self, low, high, include_high: bool = False) -> SortedTable:
        self._mutable()
        return self.without_range(low, high, include_high)

    def clear(self) -> SortedTable:
        self._mutable()
        return self._new(self.df.limit(0))

    def edit_range(self, low, high, include_high: bool, rule: edit.Rule) -> SortedTable:
        self._mutable()
        return self._new(edit.edit_range(self.df, self.keys, low, high, include_high, rule))

    def edit_all(self, rule: edit.Rule) -> SortedTable:
        return self.edit_range(None, None, False, rule)

    def edit_range_with(self, low, high, include_high: bool, edit_batch: edit.Batches, uses_counter: bool = False) -> SortedTable:
        """edit_range() by a Python function of pandas batches."""
        self._mutable()
        return self._new(edit.edit_range_with(self.df, self.keys, low, high, include_high, edit_batch, uses_counter))

    def edit_range_count(self, low, high, include_high: bool, rule: edit.Rule, initial: int = 0) -> DataFrame:
        """What the edit scan returns: ``initial`` plus the rows it visits."""
        return edit.scanned(self.df, self.keys, low, high, include_high, rule, initial)

    def added(self, pairs: DataFrame) -> DataFrame:
        """What set_pairs() without overwriting adds: the number of new keys."""
        return edit.added(self.df, self.keys, pairs)

    def removed(self, keys: DataFrame) -> DataFrame:
        """What delete_keys() removes: the number of keys that stand here. For a range that is count_range()."""
        return edit.removed(self.df, self.keys, keys)

    # persistent forms --------------------------------------------------------
    def with_(self, row: dict, overwrite: bool = True) -> SortedTable:
        one = self.df.sparkSession.createDataFrame([tuple(row.get(c) for c in self.df.columns)], self.df.schema)
        return self._new(edit.upsert(self.df, self.keys, one, overwrite))

    def with_pairs(self, pairs: DataFrame, seq: list[Column] | Column, overwrite: bool = True) -> SortedTable:
        changes = edit.collapse(pairs, self.keys, seq, last=overwrite)
        return self._new(edit.upsert(self.df, self.keys, changes, overwrite))

    def with_keys(self, keys: DataFrame, same_if_unchanged: bool = False) -> SortedTable:
        if same_if_unchanged and lookup.minus(keys.select(*self.keys.names), self.keys, self.df).isEmpty():
            return self
        return self._new(edit.with_keys(self.df, self.keys, keys))

    def without(self, key, same_if_unchanged: bool = False) -> SortedTable:
        if same_if_unchanged and not self.has(key):
            return self
        return self._new(self.df.filter(~self.keys.compare(self.df, "==", key)))

    def without_keys(self, keys: DataFrame, same_if_unchanged: bool = False) -> SortedTable:
        if same_if_unchanged and lookup.present(self.df, self.keys, keys).isEmpty():
            return self
        return self._new(lookup.minus(self.df, self.keys, keys))

    def without_range(self, low, high, include_high: bool = False, same_if_unchanged: bool = False) -> SortedTable:
        inside = self.keys.within(self.df, low, high, include_high)
        if same_if_unchanged and self.df.filter(inside).isEmpty():
            return self
        return self._new(self.df.filter(~inside))

    def filter(self, predicate: Column, counter: str | None = None, same_if_unchanged: bool = False) -> SortedTable:
        """Rows where the predicate is true (NULL drops); ``counter`` names a position column it may use."""
        df = self.df if counter is None else scan.global_counter(self.df, self.keys, counter)
        if same_if_unchanged and df.filter(~predicate | predicate.isNull()).isEmpty():
            return self
        out = df.filter(predicate)
        return self._new(out if counter is None else out.drop(counter))

    where = filter

    def filter_with(self, keep: Callable[[pd.DataFrame], pd.Series]) -> SortedTable:
        """filter() by a Python function of pandas batches."""
        return self._new(edit.filter_with(self.df, keep))

    def map_values_with(self, values: edit.Batches, schema: str) -> SortedTable:
        """map_values() by a Python function of pandas batches; ``schema`` is that of the values."""
        return self._new(edit.map_values_with(self.df, self.keys, values, schema))

    def map_values(self, **values: Column) -> SortedTable:
        if set(values) & set(self.keys.names):
            raise ValueError("map_values keeps the keys")
        return self._new(self.df.select(*self.keys.names, *[c.alias(n) for n, c in values.items()]))

    def reduce(self, **aggregates: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in aggregates.items()])

    def reduce_ordered(self, initial: Column, merge, finish=None, by: list[str] | None = None) -> DataFrame:
        return fold.ordered(self.df, self.keys, initial, merge, finish, by or [])

    # snapshots --------------------------------------------------------------
    def clone(self) -> SortedTable:
        return self._new(self.df)

    def greedy_clone(self) -> SortedTable:
        return self._new(materialize(self.df, "clone"))

    def freeze(self) -> SortedTable:
        self._frozen = True
        return self

    def unfreeze(self) -> SortedTable:
        self._frozen = False
        return self

    @property
    def is_frozen(self) -> bool:
        return self._frozen

    def check_valid(self, expected_size: int | None = None) -> None:
        audit.check_valid(self.df, self.keys, expected_size)

    # diff ---------------------------------------------------------------------
    def diff_against(self, other: SortedTable, only_a: bool = True, only_b: bool = True, different: bool = True, exact_zero: bool = False) -> DataFrame:
        if self.keys != other.keys:
            raise ValueError("both tables need the same key order")
        return diff.diff(self.df, other.df, self.keys, only_a, only_b, different, exact_zero)

    def digest(self, bucket: Column) -> DataFrame:
        """Digests of this table's buckets, to be written beside a snapshot for diff_digest()."""
        return diff.digest(self.df, bucket)

    def diff_digest(self, other: SortedTable, bucket: Column, mine: DataFrame | None = None, theirs: DataFrame | None = None) -> DataFrame:
        """diff_against() that skips buckets of equal digests; ``mine`` and ``theirs`` are stored ones of the same buckets."""
        if self.keys != other.keys:
            raise ValueError("both tables need the same key order")
        return diff.diff_digest(self.df, other.df, self.keys, bucket, mine, theirs)

    def diff_first(self, other: SortedTable, only_a: bool = True, only_b: bool = True, different: bool = True) -> DataFrame:
        """The first difference of the wanted kinds, from the highest key down: a top 1, so a task keeps one row."""
        return self.diff_against(other, only_a, only_b, different).orderBy(*self.keys.order(self.df, reverse=True)).limit(1)

    def union_keep(self, other: SortedTable) -> SortedTable:
        """Keyed union: this table's rows, then the other's for keys that are new."""
        return self._new(edit.upsert(self.df, self.keys, other.df, overwrite=False))

    def intersect(self, other: SortedTable) -> SortedTable:
        return self._new(lookup.present(self.df, self.keys, other.df))

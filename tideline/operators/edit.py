"""Upserts, deletes and declarative range edits; every one is a rewrite of an immutable frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keyspec import KeySpec
from ..storage import materialize
from .lookup import minus, present
from .scan import global_counter, stop_at, until_stop


@dataclass(frozen=True)
class Rule:
    """What an edit does to a visited row. Delete beats set; the stop row's own edit still applies.

    ``set`` maps a value column to its new value, applied where ``when`` is true. Columns may use
    ``counter`` if uses_counter; it also counts rows that get deleted.
    """

    set: dict[str, Column] = field(default_factory=dict)
    when: Column | None = None
    delete: Column | None = None
    stop: Column | None = None
    uses_counter: bool = False


def collapse(pairs: DataFrame, keys: KeySpec, seq: list[Column] | Column, last: bool = True) -> DataFrame:
    """One row for each key: the last (first) by ``seq``; combined on the map side before the one shuffle."""
    seq = seq if isinstance(seq, list) else [seq]
    pick = F.max_by if last else F.min_by
    whole = F.struct(*pairs.columns)
    return pairs.groupBy(*keys.names).agg(pick(whole, F.struct(*seq)).alias("_row")).select("_row.*")


def upsert(df: DataFrame, keys: KeySpec, changes: DataFrame, overwrite: bool = True) -> DataFrame:
    """Changes have unique keys. An overwrite replaces the stored key too."""
    changes = changes.select(*df.columns)
    if overwrite:
        return minus(df, keys, changes).unionByName(changes)
    return df.unionByName(minus(changes, keys, df))


def added(df: DataFrame, keys: KeySpec, pairs: DataFrame) -> DataFrame:
    """How many keys an upsert adds; a repeated key counts once."""
    return minus(pairs.select(*keys.names).distinct(), keys, df).agg(F.count(F.lit(1)).alias("n"))


def removed(df: DataFrame, keys: KeySpec, gone: DataFrame) -> DataFrame:
    """How many rows a keyed delete removes; a repeated key counts once."""
    return present(df, keys, gone).agg(F.count(F.lit(1)).alias("n"))


def change_if_present(df: DataFrame, keys: KeySpec, changes: DataFrame) -> DataFrame:
    """New values for keys that exist; other changes are dropped. Changes have unique keys."""
    values = [c for c in changes.columns if c not in keys.names]
    side = changes.withColumn("_hit", F.lit(True)).alias("c")
    out = df.alias("t").join(side, keys.same("t", "c"), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}") for c in df.columns])


def with_keys(df: DataFrame, keys: KeySpec, new: DataFrame) -> DataFrame:
    """Set union on keys: rows that exist stay; new keys come with NULL values."""
    fresh = minus(new.select(*keys.names).distinct(), keys, df)
    return df.unionByName(fresh, allowMissingColumns=True).select(*df.columns)


def _active(df: DataFrame, keys: KeySpec, low, high, include_high: bool, rule: Rule, initial: int = 0) -> DataFrame:
    inside = df.filter(keys.within(df, low, high, include_high))
    if rule.uses_counter:
        inside = global_counter(inside, keys, "counter", initial)
    return inside if rule.stop is None else stop_at(inside, keys, rule.stop)


def edit_range(df: DataFrame, keys: KeySpec, low, high, include_high: bool, rule: Rule) -> DataFrame:
    """Rows of the range edited by ``rule``. Without a counter this is a pass with no shuffle; a stop adds a top 1 before it, and a counter a
    sort of the range alone.
    """
    on = F.lit(True) if rule.when is None else F.coalesce(rule.when, F.lit(False))
    gone = F.lit(False) if rule.delete is None else F.coalesce(rule.delete, F.lit(False))
    if set(rule.set) & set(keys.names):
        raise ValueError("an edit keeps the keys")

    def edited(active: Column) -> list[Column]:
        return [F.when(active & on, rule.set[c]).otherwise(F.col(c)).alias(c) if c in rule.set else F.col(c) for c in df.columns]

    inside = F.coalesce(keys.within(df, low, high, include_high), F.lit(False))
    if rule.uses_counter:
        counted = global_counter(df.filter(inside), keys, "counter")
        wide, active = (counted, F.lit(True)) if rule.stop is None else until_stop(counted, counted, keys, rule.stop)
        return wide.filter(~(active & gone)).select(*edited(active)).unionByName(df.filter(~inside))
    wide, active = (df, inside) if rule.stop is None else until_stop(df, df.filter(inside), keys, rule.stop)
    active = inside & active
    return wide.filter(~(active & gone)).select(*edited(active))


Batches = Callable[[pd.DataFrame], pd.DataFrame]


def edit_range_with(df: DataFrame, keys: KeySpec, low, high, include_high: bool, edit: Batches, uses_counter: bool = False) -> DataFrame:
    """Rows of the range edited by Python, for what a Rule cannot say.

    ``edit`` gets a pandas frame of some rows of the range, with ``counter`` if uses_counter, and returns them in the same order
    with new values. Boolean columns ``_delete`` and ``_stop`` may come with them: rows of a true ``_delete`` go, and nothing after the first true
    ``_stop`` in key order is edited. It is called on batches in any order, also of rows past the stop, whose edits are dropped.
    """
    inside = F.coalesce(keys.within(df, low, high, include_high), F.lit(False))
    rows = global_counter(df.filter(inside), keys, "counter") if uses_counter else df.filter(inside)
    old, cols, key_names = F.struct(*df.columns), df.columns, keys.names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema += f", _delete boolean, _stop boolean, _old {rows.select(old.alias('o')).schema['o'].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, given = b["_old"], b.drop(columns="_old")
            out = edit(given.copy()).reset_index(drop=True)
            if len(out) != len(b) or any(not out[k].equals(given[k].reset_index(drop=True)) for k in key_names):
                raise ValueError("an edit returns the rows that it gets, with their keys")
            flags = {c: out[c].fillna(False).astype(bool) if c in out else False for c in ("_delete", "_stop")}
            yield out[cols].assign(**flags, _old=held.reset_index(drop=True))

    done = materialize(rows.withColumn("_old", old).mapInPandas(run, schema), "edited")
    wide, active = until_stop(done, done, keys, F.col("_stop"))
    kept = wide.filter(~(active & F.col("_delete"))).select(*[F.when(active, F.col(c)).otherwise(F.col("_old")[c]).alias(c) for c in df.columns])
    return kept.unionByName(df.filter(~inside))


def filter_with(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which ``keep`` gives true, asked in Arrow batches of pandas frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[pd.Series(keep(b)).fillna(False).astype(bool).to_numpy()]

    return df.mapInPandas(run, df.schema)


def map_values_with(df: DataFrame, keys: KeySpec, values: Batches, schema: str) -> DataFrame:
    """Keys with the value columns, of ``schema``, that ``values`` gives for each Arrow batch of rows, in their order."""
    key_names = keys.names
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in key_names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = values(b)
            yield pd.concat([b[key_names].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{kinds}, {schema}")


def scanned(df: DataFrame, keys: KeySpec, low, high, include_high: bool, rule: Rule, initial: int = 0) -> DataFrame:
    return _active(df, keys, low, high, include_high, rule, initial).agg((F.count(F.lit(1)) + initial).alias("n"))

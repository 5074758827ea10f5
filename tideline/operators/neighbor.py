"""Nearest-key lookups: one constant, batches by a partition column, batches in one global order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..keyspec import Key, KeySpec
from ..storage import materialize, spread

_BEFORE_ALL, _AFTER_ALL = 0, 2


def nearest(df: DataFrame, keys: KeySpec, key, direction: str, strict: bool) -> DataFrame:
    """One constant probe; ``key`` None gives the highest (direction lower) or lowest row."""
    lower = direction == "lower"
    if key is not None:
        df = df.filter(keys.compare(df, ("<" if lower else ">") + ("" if strict else "="), key))
    return df.orderBy(*keys.order(df, reverse=lower)).limit(1)


class Sweep:
    """Table rows and probes in one order, where a probe's match is the last table row before it or the first after.

    The order is that of the table's key ``on``: its direction, NaN below all numbers, and its place of
    NULL if the spec allows them. Otherwise rows of the table without a key take no part, and a NULL
    probe is an open end, as in nearest(): the highest row downwards, the lowest upwards.
    """

    def __init__(
        self, table: DataFrame, probes: DataFrame, keys: KeySpec, on: str, probe_on: str, by: list[str], values: list[str], direction: str,
        strict: bool,
    ):
        self.on, self.values, self.before = on, values, direction == "lower"
        key = next((k for k in keys.keys if k.name == on), Key(on))
        if not keys.allow_null:
            table = table.filter(F.col(on).isNotNull())
            key = replace(key, nulls="last" if self.before else "first")
        self.by = [f"_by{i}" for i in range(len(by))]
        match = F.struct(F.col(on).alias("on"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
        kind = table.schema[on].dataType
        groups = [F.col(b).alias(n) for b, n in zip(by, self.by, strict=True)]
        left = table.select(*groups, F.col(on).alias("_at"), F.lit(0).alias("_side"), match.alias("_match"))
        right = probes.select(*groups, F.col(probe_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_probe"))
        self.rows = left.unionByName(right, allowMissingColumns=True)
        self.key = replace(key, name="_at")
        # groups go the way that the key goes, so that the last row of all is the largest or the smallest
        groups = [F.col(b).asc_nulls_first() if key.ascending else F.col(b).desc_nulls_last() for b in self.by]
        self.by_key = [*groups, *KeySpec((self.key,)).order(self.rows)]
        # a sweep goes with the key for the rows before, against it for those after; at a probe's own key table rows come first if they fit
        self.order = [*KeySpec((self.key,)).order(self.rows, reverse=not self.before), F.col("_side").desc() if strict else F.col("_side").asc()]
        self.floats = isinstance(kind, (T.DoubleType, T.FloatType))
        self.names = list(probes.columns)

    def hit(self, *by: str) -> Column:
        """The last table row so far. Spark reads a frame that ends with the partition anew for each row, so both directions use one that begins with it."""
        w = Window.partitionBy(*by).orderBy(*self.order)
        return F.last("_match", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def edge(self) -> Column:
        """The table row that is last (first) in the order, as an aggregate."""
        first = self.key.nulls == "first" if self.key.nulls else None
        x = F.col("_at")
        if first is None:  # the type's own place, as KeySpec has it
            first = not isinstance(self.rows.schema["_at"].dataType, (T.BooleanType, T.NumericType))
            first = first if self.key.ascending else not first
        null = F.when(x.isNull(), _BEFORE_ALL if first == self.key.ascending else _AFTER_ALL).otherwise(1)
        place = F.struct(*self.by, null, *[F.when(F.isnan(x), 0).otherwise(1)] * self.floats, x)
        return (F.max_by if self.before == self.key.ascending else F.min_by)(F.struct("_match", *self.by), place)

    def result(self, swept: DataFrame, match: Column) -> DataFrame:
        """Each probe with the match's key and values, under names that the probe does not have: ``matched_`` goes before as often as needed."""
        out = swept.withColumn("_hit", match).filter(F.col("_side") == 1)
        taken, cols = {*self.names}, []
        for name, at in [(f"matched_{self.on}", "on"), *[(v, f"v{i}") for i, v in enumerate(self.values)]]:
            while name in taken:
                name = f"matched_{name}"
            taken.add(name)
            cols.append(F.col(f"_hit.{at}").alias(name))
        return out.select("_probe.*", *cols)


def asof_by(
    table: DataFrame, probes: DataFrame, keys: KeySpec, on: str, probe_on: str, by: list[str], values: list[str], direction: str,
    strict: bool,
) -> DataFrame:
    """For each probe the table row of the same ``by`` that is nearest in the direction, else NULLs.

    Both sides are united and swept once by a window, so the plan is one shuffle on ``by``
    and a sort. The table's keys must be unique within ``by``. Order and names are those of Sweep.
    """
    sweep = Sweep(table, probes, keys, on, probe_on, by, values, direction, strict)
    return sweep.result(sweep.rows, sweep.hit(*sweep.by))


def asof_global(
    table: DataFrame, probes: DataFrame, keys: KeySpec, on: str, probe_on: str, by: list[str], values: list[str], direction: str,
    strict: bool, partitions: int | None = None,
) -> DataFrame:
    """The same in one global order, for tables without ``by`` or with a hot value of it: range partitions are swept on their own, then each
    takes over
    the boundary match of the partitions before (after) it, if that is of its ``by``. One row for each partition is broadcast.
    """
    spark = table.sparkSession
    sweep = Sweep(table, probes, keys, on, probe_on, by, values, direction, strict)
    n = partitions or spread(sweep.rows)
    dealt = sweep.rows.repartitionByRange(n, *sweep.by_key)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "asof")
    held = dealt.filter(F.col("_side") == 0).groupBy("_part").agg(sweep.edge().alias("_edge"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("_part")).join(held, "_part", "left")
    across = Window.orderBy(F.col("_part").asc() if sweep.before else F.col("_part").desc())
    carry = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carries = parts.select("_part", carry.alias("_carry"))
    swept = dealt.withColumn("_local", sweep.hit("_part", *sweep.by)).join(F.broadcast(carries), "_part")  # one row for each partition
    own = F.lit(True)
    for b in sweep.by:
        own = own & F.col(b).eqNullSafe(F.col(f"_carry.{b}"))
    return sweep.result(swept, F.coalesce(F.col("_local"), F.when(own, F.col("_carry._match"))))

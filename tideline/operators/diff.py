"""Keyed difference of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keyspec import KeySpec


def diff(a: DataFrame, b: DataFrame, keys: KeySpec, only_a: bool = True, only_b: bool = True, different: bool = True, exact_zero: bool = False) -> DataFrame:
    """(keys, status, a_*, b_*) for keys of one side only and for keys whose values differ.

    Value equality is null-safe and takes NaN as equal to NaN; exact_zero also tells -0.0 from 0.0.
    """
    values = [c for c in a.columns if c not in keys.names]
    if set(values) != {c for c in b.columns if c not in keys.names}:
        raise ValueError("both tables need the same value columns")
    x = a.withColumn("_in", F.lit(True)).alias("a")
    y = b.withColumn("_in", F.lit(True)).alias("b")
    kind = "full" if only_a and only_b else "left" if only_a else "right" if only_b else "inner"
    both = x.join(y, keys.same("a", "b"), kind)
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        if exact_zero:
            same = same & F.col(f"a.{c}").cast("string").eqNullSafe(F.col(f"b.{c}").cast("string"))
    status = F.when(F.col("b._in").isNull(), "only_a").when(F.col("a._in").isNull(), "only_b").when(~same, "different")
    wanted = [s for s, on in (("only_a", only_a), ("only_b", only_b), ("different", different)) if on]
    cols = [F.when(F.col("a._in"), F.col(f"a.{n}")).otherwise(F.col(f"b.{n}")).alias(n) for n in keys.names]
    out = both.select(*cols, status.alias("status"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in values for s in "ab"])
    return out.filter(F.col("status").isin(wanted))


def digest(df: DataFrame, bucket: Column) -> DataFrame:
    """(_bucket, n, x, s): the row count of each bucket and two sums over 64-bit row hashes with different seeds.

    A snapshot's digests can be written beside it, so that later diffs read them instead of the snapshot.
    """
    cols = sorted(df.columns)
    h = F.xxhash64(*cols)
    g = F.xxhash64(F.lit(True), *reversed(cols), h)
    return df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(g.cast("decimal(38,0)")).alias("s"))


def diff_digest(a: DataFrame, b: DataFrame, keys: KeySpec, bucket: Column, of_a: DataFrame | None = None, of_b: DataFrame | None = None) -> DataFrame:
    """The same rows as diff(), after buckets with equal digests on both sides are skipped.

    ``of_a`` and ``of_b`` are stored digests of the two; one that is not given is made from its table. Equal
    digests of unequal buckets need a coincidence of about 2^-128; diff() compares every row.
    """
    x = (digest(a, bucket) if of_a is None else of_a).alias("a")
    y = (digest(b, bucket) if of_b is None else of_b).alias("b")
    moved = x.join(y, F.col("a._bucket").eqNullSafe(F.col("b._bucket")), "full")
    moved = moved.filter(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.s").eqNullSafe(F.col("b.s"))))
    moved = moved.select(F.coalesce("a._bucket", "b._bucket").alias("_moved"))
    keep = lambda df: df.withColumn("_bucket", bucket).join(moved, F.col("_bucket").eqNullSafe(F.col("_moved")), "left_semi").drop("_bucket")
    return diff(keep(a), keep(b), keys)

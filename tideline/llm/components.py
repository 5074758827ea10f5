"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bytes_read, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, many: int = 64 << 20) -> DataFrame:
    """(node, component): for each node of an edge the least node that it is connected with.

    Alternates two rewrites of the edge table until it no longer changes, each a shuffle
    with partial aggregation. Large star: each node's larger neighbours are linked to the least node
    around it. Small star: a node and its smaller neighbours are linked to the least of them.
    Rounds grow with the logarithm of the largest component. Nodes of any comparable type; edges with a
    null end and loops say nothing; repeated edges count once; no edges give no rows. Each
    round is written, so a lost executor costs at most one round. Where the links have ``many`` bytes or more, the least neighbours are
    written, too: their join with the links is then one of plain shuffles, which Spark splits where a node has very many of them.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("_a"), F.col(b).isNotNull().alias("_b"))
    links = links.filter("_a AND _b AND u <> v").select("u", "v").distinct()
    links, before = materialize(links, "links"), None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if bytes_read(links) >= many:
            least = materialize(least, "least")
        # large star: u's neighbours v > u take m(u)
        large = links.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its neighbours v < u take the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x"))
        links = materialize(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)

"""Connected components of a link table, as a few rounds of joins and grouped minima.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) shrink every component to a star around its smallest node. All
groupings are grouped minima, which Spark combines before the shuffle, and joins, whose hot
keys adaptive execution can split; no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, of one type).

    The component is its smallest node. Self links and repeated links are harmless.
    """
    now = saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small)
        mark, last = _mark(now), mark
        if mark == last:
            break
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest: ``parents`` holds for each node (a) but the roots one smaller node (b).

    The component is the root, found by pointer jumping: the paths halve with every round.
    """
    now = saved(parents.select(F.col("a").alias("node"), F.col("b").alias("component"), F.lit(True).alias("moved")))
    for _ in range(MAX_ROUNDS):
        up = now.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        now = saved(now.select("node", "component").join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"), F.col("_up").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"no roots after {MAX_ROUNDS} rounds")
    return now.select("node", "component").union(now.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return (r.n, r.x, r.s)

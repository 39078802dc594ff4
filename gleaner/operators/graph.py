"""Graph analytics over edge lists: affinity, degree-capped matching, centrality, interval cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import saved

#: Fixed value: nodes of a snapshot of the graph at most.
NEWEST = 5000


def centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, degree, gravity, radius, hub) of nodes (id) by distinct neighbours in links (source_id, target_id).

    Hubs: degree at least max(3, twice the upper median), at most min(8, max(1, ceil(0.8 %))) of them, highest degree first.
    Median and maximum come from the distribution of degrees, hubs from a top-k: no global sort of the nodes.
    """
    ids = nodes.select("id").distinct()
    both = links.where("source_id <> target_id").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))).alias("e")).select("e.*").distinct()
    both = both.join(ids, "id", "left_semi").join(ids.withColumnRenamed("id", "other"), "other", "left_semi")
    degrees = ids.join(both.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    spread = degrees.groupBy("degree").agg(F.count("*").alias("c"))  # one row a degree
    running = spread.select("degree", F.sum("c").over(Window.orderBy("degree")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"), F.max("degree").over(Window.partitionBy()).alias("top"))
    stats = running.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("degree"))).alias("median"), F.max("n").alias("n"), F.max("top").alias("top"))  # one row
    all_ = degrees.crossJoin(F.broadcast(stats))
    least = F.greatest(F.lit(3), 2 * F.col("median"))
    best = all_.where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(8)
    k = F.row_number().over(Window.orderBy(F.desc("degree"), "id"))
    hubs = best.withColumn("k", k).where(F.col("k") <= F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.col("n") * 0.008)))).select("id", F.lit(True).alias("_hub"))  # at most eight rows
    gravity = F.when(F.col("top") > 0, F.log1p("degree") / F.log1p("top")).otherwise(0.0)
    return all_.join(F.broadcast(hubs), "id", "left").select("id", "degree", F.round(gravity, 6).alias("gravity"), F.round(4 + F.least(F.lit(12.0), 2.2 * F.log2(F.col("degree") + 1)), 6).alias("radius"), F.coalesce("_hub", F.lit(False)).alias("hub"))


#: Words that say nothing about what two texts share.
STOP_WORDS = (
    "about after again also and are been before being but can could did does for from had has have into its more not our should that the their then "
    "there these they this through was were will with would your"
).split()
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"


def affinity_terms(text: Column) -> Column:
    """The term set of a text: ASCII words without stop words, and the two-character grams of its CJK runs."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9][a-z0-9_-]{1,63})"), 1), lambda w: ~w.isin(*STOP_WORDS))
    runs = F.filter(F.regexp_extract_all(low, F.lit(f"({_CJK})"), 1), lambda r: F.length(r) >= 2)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, grams))


def affinity(docs: DataFrame, least: float = 0.16, text: str = "content", newest: int = NEWEST, tile: int = 128) -> DataFrame:
    """(source, target, weight): Ochiai similarity of the term sets of documents (id), from ``least`` on.

    A snapshot of the graph has the ``newest`` documents (those of the highest ids) as nodes, so its edges are bounded however many documents there
    are. At a weight as low as this nearly every pair shares a term that counts, so pairs are not searched for by
    terms: nodes are dealt into tiles, and each pair of tiles is one product of incidence matrices over the terms that both have.
    A frequent term is a column like any other.
    """
    sets = docs.select("id", affinity_terms(F.col(text)).alias("terms")).where(F.size("terms") > 0).orderBy(F.desc("id")).limit(newest)
    sets = saved(sets)  # at most ``newest`` rows
    tiles = max(1, -(-sets.count() // tile))
    mine = F.pmod(F.xxhash64("id"), F.lit(tiles))
    dealt = sets.withColumn("_t", mine).withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = dealt.select(F.least("_t", "_u").alias("_a"), F.greatest("_t", "_u").alias("_b"), (F.col("_t") <= F.col("_u")).alias("_left"), (F.col("_t") >= F.col("_u")).alias("_right"), "id", "terms")
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("source", kind), T.StructField("target", kind), T.StructField("w", T.DoubleType())])

    def product(t: pa.Table) -> pa.Table:
        lists = t.column("terms").combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        coded = np.asarray(lists.flatten().dictionary_encode().indices)
        shared = np.bincount(coded) > 1  # a term of one node is in no product
        row, coded = np.repeat(np.arange(len(sizes)), sizes)[shared[coded]], (np.cumsum(shared) - 1)[coded[shared[coded]]]
        held = np.zeros((len(sizes), max(1, int(shared.sum()))), np.float32)
        held[row, coded] = 1
        left, right = (np.flatnonzero(np.asarray(t.column(c))) for c in ("_left", "_right"))
        weight = (held[left] @ held[right].T).astype(np.float64) / np.sqrt(sizes[left, None].astype(np.float64) * sizes[None, right])
        i, j = np.nonzero(weight >= least)
        ids, w = t.column("id").combine_chunks(), weight[i, j]
        one, other = ids.take(pa.array(left[i])), ids.take(pa.array(right[j]))
        # a pair of two tiles stands once, one within a tile twice: the smaller id first, and no node with itself
        first = pc.less(one, other)
        swapped = pc.and_(pc.greater(one, other), pa.array(np.full(len(i), t.column("_a")[0].as_py() != t.column("_b")[0].as_py())))
        keep = pc.or_(first, swapped)
        return pa.table([pc.if_else(first, one, other).filter(keep), pc.if_else(first, other, one).filter(keep), pa.array(w).filter(keep)], names=schema.names)

    return dealt.groupBy("_a", "_b").applyInArrow(product, schema).select("source", "target", F.round("w", 4).alias("weight"))


def capped(edges: DataFrame, most: int, rounds: int = 200) -> DataFrame:
    """Greedy choice of edges (heaviest first, then by ids) with at most ``most`` a node, in parallel rounds.

    An edge is final once it is among the first ``most - taken`` of the open edges at both ends: the greedy order would
    take it too. Each round takes all such edges and drops those at full nodes; it equals the sequential result.
    """
    key = F.struct((-F.col("weight")).alias("w"), "source", "target")
    left = edges.select("source", "target", "weight")
    taken = left.where("false")
    for _ in range(rounds):
        counts = taken.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
        ends = left.select("source", "target", "weight", F.explode(F.array("source", "target")).alias("node")).join(counts, "node", "left")
        place = F.row_number().over(Window.partitionBy("node").orderBy(key))
        judged = ends.select("source", "target", "weight", (F.coalesce("c", F.lit(0)) >= most).alias("full"), (place + F.coalesce("c", F.lit(0)) <= most).alias("first"))
        state = judged.groupBy("source", "target", "weight").agg(F.bool_or("full").alias("full"), F.bool_and("first").alias("first"))
        state = saved(state)
        now = state.where("first and not full").select("source", "target", "weight")
        taken = taken.unionByName(now)
        left = state.where("not first and not full").select("source", "target", "weight")
        if left.isEmpty():
            return taken
    raise RuntimeError(f"edges are still open after {rounds} rounds")


def covered(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, covered): days that each key's half-open intervals cover, overlaps once."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.datediff(F.col(end), F.greatest(F.col(start), F.coalesce(F.max(end).over(before), F.col(start)))))
    return intervals.select(key, fresh.alias("fresh")).groupBy(key).agg(F.sum("fresh").alias("covered"))

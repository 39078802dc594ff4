"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are compared where their labels (and lengths) are equal. Identical vectors collapse to
one. The rest of a label is dealt over tiles of at most about TILE_ROWS vectors, and each pair of tiles is
one group: unit vectors are quantised to int8 with a scale of their own, the int8 products
give every pair's cosine up to a bound that follows from both vectors' measured
quantisation errors, and only pairs whose interval holds the threshold are computed again in
double precision. A tile pair returns counts of links and a spanning forest of them,
never pairs, so a large group of near copies stays linear in rows.

With a = x - ex and b = y - ey for unit x, y: |x.y - a.b| <= |ex| + (1 + |ex|) |ey|.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label or null vec_id, link with nothing and are their own component (null
for a null vec_id; then kept). Rows that share a vec_id and a vector count as separate copies; rows that
share a vec_id but not the vector are one vertex of the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .links import components

THRESHOLD = 0.98
TILE_ROWS = 2048
#: Beyond the quantisation bound, room for rounding in float64 and in the products.
SLACK = 1e-9
#: Dimensions whose int8 products float32 still adds up exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT_DIMS = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes, scales and the norms of the quantisation errors."""
    # divided by the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - codes * scale[:, None]
    return unit, codes, scale, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def tile_links(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Boolean matrix of the links between two quantised tiles."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    dots = np.zeros((len(qa), len(qb)), np.float64)
    for d in range(0, qa.shape[1], EXACT_DIMS):
        dots += qa[:, d : d + EXACT_DIMS].astype(np.float32) @ qb[:, d : d + EXACT_DIMS].astype(np.float32).T
    dots *= sa[:, None]
    dots *= sb[None, :]
    bound = ea[:, None] + (1 + ea)[:, None] * eb[None, :] + SLACK
    links = dots - bound >= threshold
    i, j = np.nonzero((dots + bound >= threshold) & ~links)
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        links[p, q] = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
    return links


def forest(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest id of its component."""
    root = ids.copy()
    left = links.any(axis=1)
    while left.any():
        seen = np.zeros(len(ids), bool)
        edge = np.array([np.argmax(left)])
        seen[edge] = True
        while len(edge):
            reached = links[edge].any(axis=0) & ~seen
            seen |= reached
            edge = np.nonzero(reached)[0]
        root[seen] = ids[seen].min()
        left &= ~seen
    return root


def compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of tiles (or one tile with itself): links counted, forest returned."""
        first = pdf["side"].to_numpy() == 0
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        x = np.array(pdf["vector"].tolist(), np.float64)
        n_links = np.zeros(len(pdf), np.int64)
        if first.all():
            q = quantised(x)
            links = tile_links(q, q, threshold)
            np.fill_diagonal(links, False)
            links |= links.T
            n_links = links @ copies
            both = links
        else:
            ia, ib = np.nonzero(first)[0], np.nonzero(~first)[0]
            if not len(ia):
                return pd.DataFrame({"id": ids[:0], "root": ids[:0], "links": n_links[:0]})
            links = tile_links(quantised(x[ia]), quantised(x[ib]), threshold)
            n_links[ia], n_links[ib] = links @ copies[ib], copies[ia] @ links
            if not links.any():
                return pd.DataFrame({"id": ids[:0], "root": ids[:0], "links": n_links[:0]})
            # the links between the tiles, over those of their nodes that have one
            ra, rb = np.nonzero(links.any(axis=1))[0], np.nonzero(links.any(axis=0))[0]
            live = np.concatenate((ia[ra], ib[rb]))
            both = np.zeros((len(live), len(live)), bool)
            both[: len(ra), len(ra) :] = links[np.ix_(ra, rb)]
            both |= both.T
            return pd.DataFrame({"id": ids[live], "root": forest(both, ids[live]), "links": n_links[live]})
        live = n_links > 0
        return pd.DataFrame({"id": ids[live], "root": forest(both, ids)[live], "links": n_links[live]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("k1", F.xxhash64("label", "vector")).withColumn("k2", F.xxhash64(F.lit(1), "vector", "label"))
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = saved(classes.withColumn("dims", F.size("vector")))
    tiles = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = classes.select("id", "copies", "label", "dims", "vector").join(tiles, ["label", "dims"]).withColumn("tile", F.expr("pmod(xxhash64(id, 7), tiles)").cast("int"))
    # each tile meets itself and every other once: the pair (low, high) gets the low tile as side 0
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.select("label", "dims", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "id", "copies", "vector")
    found = saved(meets.groupBy("label", "dims", "low", "high").applyInPandas(compare(threshold), "id long, root long, links long"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("k1", "k2", "id", "copies")
        .join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select("k1", "k2", F.col("copies").alias("_copies"), F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("component", "id").alias("_component"))
    )
    keyed = rows.select("vec_id", F.when(F.col("usable"), F.col("k1")).alias("k1"), F.when(F.col("usable"), F.col("k2")).alias("k2"))
    return keyed.join(per_class, ["k1", "k2"], "left").select(
        "vec_id",
        F.coalesce(F.col("_links") + F.col("_copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(True)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), n AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(node, other) AS (
  SELECT a, b FROM pairs
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
), comp AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN comp c ON c.node = e.vec_id
"""

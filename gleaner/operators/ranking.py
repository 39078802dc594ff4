"""Ranks and their fusion: per-query ranks, reciprocal-rank fusion, recency and rerank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

RRF_K = 60


def ranked(hits: DataFrame, *order: Column, by: str | list[str] = "query_id", limit: int | None = None, name: str = "rank") -> DataFrame:
    """1-based ranks within each query; ``order`` must end in a unique column."""
    keys = [by] if isinstance(by, str) else by
    out = hits.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= limit) if limit is not None else out


def fused(channels: list[DataFrame], key: str = "id", by: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of channels (query_id, key, rank and optionally weight), hits summed over channels."""
    parts = [c.select(by, key, "rank", (F.col("weight") if "weight" in c.columns else F.lit(1.0)).alias("weight")) for c in channels]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(by, key).agg(F.sum(F.col("weight") / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"), F.count("*").alias("channels"))


def rolled_up(hits: DataFrame, parent: str, by: str = "query_id") -> DataFrame:
    """A parent takes its best child's score."""
    return hits.groupBy(by, parent).agg(F.max("score").alias("score"))


def query_fused(hits: DataFrame, by: str = "query_id", source: str = "subquery", key: str = "id") -> DataFrame:
    """Several rankings of one query in one: summed reciprocal ranks, best rank, the first subquery that gave it."""
    return hits.groupBy(by, key).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.min(F.struct("rank", source))[source].alias("first_query"),
    )


def recency_fused(hits: DataFrame, weight: float, by: str = "query_id") -> DataFrame:
    """Fuse relevance (``rank``) with recency (updated_at): (1 - w) / (60 + rank) + w / (60 + recency rank)."""
    recent = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("updated_at"), "id"))
    return hits.withColumn("recency_rank", recent).withColumn("score", F.lit(1 - weight) / (RRF_K + F.col("rank")) + F.lit(weight) / (RRF_K + F.col("recency_rank")))


def rerank_fused(hits: DataFrame, weight: float, min_score: float = 0.0, by: str = "query_id") -> DataFrame:
    """Fuse a reranker's order (``rerank_score`` in [0, 1]) with the first ranking.

    Rows below ``min_score`` go before ranks are given. A query whose scores are not all finite and in
    [0, 1] keeps its first order and score.
    """
    sound = F.min(F.coalesce(F.col("rerank_score").between(0, 1), F.lit(False)).cast("int")).over(Window.partitionBy(by)) == 1
    good = hits.withColumn("_sound", sound)
    kept = good.where(F.col("_sound") & (F.col("rerank_score") >= min_score))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rerank_score"), "rank", "id"))
    kept = kept.withColumn("rerank_rank", place).withColumn("score", F.lit(weight) / (RRF_K + F.col("rerank_rank")) + F.lit(1 - weight) / (RRF_K + F.col("rank")))
    rest = good.where(~F.col("_sound")).withColumn("rerank_rank", F.lit(None).cast("int")).withColumn("score", 1.0 / (RRF_K + F.col("rank")))
    return kept.unionByName(rest.select(kept.columns)).drop("_sound")


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their 1-based place in one order over the whole table; ``order`` must end in a unique column.

    A range sort deals the rows over all tasks; a row's place is the one within its range plus the rows of the ranges before.
    """
    at = F.col("_at")
    sorted_rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(at, 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = sorted_rows.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn(name, F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")

"""Joint context: one packet a query of memories, code, anchors and conflicts, from rankings made before.

An anchor is a citation of a ranked memory, assessed in the asked revision. Quotas hold for each kind, so a query's packet is small; what is ranked within
a query are the hits and citations that the rankings let through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

#: Memories, code artifacts and anchors of a packet at most, and the anchors whose dependencies are compared.
MEMORIES, CODE, ANCHORS, COMPARED = 5, 10, 25, 5
#: Verdicts of a comparison, the gravest first.
GRAVITY = ("affected", "possibly_affected", "unknown", "unaffected")


def _placed(rows: DataFrame, *order, most: int, name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col(name) <= most)


def anchors(memories: DataFrame, citations: DataFrame, most: int = ANCHORS) -> DataFrame:
    """(query_id, position, and the citation's columns): citations of the ranked memories, memory by memory."""
    return _placed(memories.select("query_id", "rank", F.col("id").alias("memory_id")).join(citations, "memory_id"), "rank", "evidence_id", most=most)


def packet(memory_hits: DataFrame, code_hits: DataFrame, citations: DataFrame, impact: DataFrame | Callable[[DataFrame], DataFrame], memories: int = MEMORIES, code: int = CODE, most_anchors: int = ANCHORS, compared: int = COMPARED) -> DataFrame:
    """(query_id, kind, position, item): the typed rows of every query's packet.

    memory_hits and code_hits: query_id, id, rank; citations: evidence_id, memory_id, relationship, state, artifact_id (null where none is
    valid), subject; impact: subject, verdict, or what gives it of the subjects asked for (subject, distinct). Cited memories and artifacts come before the others of their kind. Conflicts are
    contradicting citations, those whose state is neither current nor moved, and the gravest verdict over the first compared subjects (unknown where
    one has none) unless it is ``unaffected``.
    """
    memory_hits = memory_hits.where(F.col("rank") <= memories)
    # a few a query, asked five times: the citations are met once
    held = saved(anchors(memory_hits, citations, most_anchors))
    cited = held.select("query_id", F.col("memory_id").alias("id")).distinct().withColumn("_cited", F.lit(True))
    first = memory_hits.join(cited, ["query_id", "id"], "left")
    out = [_placed(first, F.col("_cited").isNull(), "rank", most=memories).select("query_id", F.lit("memory").alias("kind"), "position", F.col("id").cast("string").alias("item"))]
    anchored = held.where("artifact_id is not null").groupBy("query_id", F.col("artifact_id").alias("id")).agg(F.min("position").alias("place"))
    found = code_hits.where(F.col("rank") <= code).join(anchored, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(1).alias("part"), F.col("rank").alias("place"))
    both = anchored.select("query_id", "id", F.lit(0).alias("part"), "place").unionByName(found)
    out.append(_placed(both, "part", "place", "id", most=code).select("query_id", F.lit("code").alias("kind"), "position", F.col("id").cast("string").alias("item")))
    out.append(held.select("query_id", F.lit("anchor").alias("kind"), "position", F.concat_ws(":", "evidence_id", "relationship", "state").alias("item")))
    says = F.array_compact(F.array(F.when(F.col("relationship") == "contradicts", F.lit("contradicts")), F.when(~F.col("state").isin("current", "moved"), F.col("state"))))
    conflicts = held.select("query_id", "position", "evidence_id", F.posexplode(says).alias("n", "what")).select("query_id", (F.col("position") * 2 + F.col("n")).alias("place"), F.concat_ws(":", F.lit("anchor"), "evidence_id", "what").alias("item"))
    grave = F.array_position(F.array(*map(F.lit, GRAVITY)), F.coalesce("verdict", F.lit("unknown")))
    # only anchors whose revision is indexed have subjects to compare
    subjects = _placed(held.where("subject is not null and state <> 'unverifiable'").drop("position"), "rank", "evidence_id", most=compared)
    subjects = subjects.join(impact(subjects.select("subject").distinct()) if callable(impact) else impact, "subject", "left")
    worst = subjects.groupBy("query_id").agg(F.min(grave).alias("g")).where(F.col("g") < len(GRAVITY))
    worst = worst.select("query_id", F.lit(10_000).cast("long").alias("place"), F.concat(F.lit("contextual-impact:"), F.element_at(F.array(*map(F.lit, GRAVITY)), F.col("g").cast("int"))).alias("item"))
    out.append(_placed(conflicts.unionByName(worst), "place", most=2 * most_anchors + 1).select("query_id", F.lit("conflict").alias("kind"), "position", "item"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def delivered(rows: DataFrame) -> DataFrame:
    """(query_id, route, and the counts of each kind): what a packet holds."""
    n = lambda k: F.count_if(F.col("kind") == k)
    route = F.when((n("memory") > 0) & (n("code") > 0), "both").when(n("memory") > 0, "memory-only").when(n("code") > 0, "code-only").otherwise("abstain")
    return rows.groupBy("query_id").agg(route.alias("route"), *(n(k).alias(f"n_{k}") for k in ("memory", "code", "anchor", "conflict")))

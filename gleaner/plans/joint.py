"""Joint context retrieval: memory and code rankings, evidence and impact in one packet a passage.

Passages ask the hybrid search for memories and, by their number, one of the code search's words for artifacts. An order is a citation:
of the memory that its number leads to, of its smallest part, assessed by the drift of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joint as J
from ..operators import ranking as R
from ..sources.tables import saved, table
from . import code, retrieval
from .registry import ORACLE_SQL, query

_RELATION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'contradicts' WHEN '2-HIGH' THEN 'supports' ELSE 'implements' END"
_PACKET = f"""m AS (SELECT query_id, id, rank FROM ({ORACLE_SQL["hybrid_search"]}) WHERE rank <= 5), w AS (SELECT count(DISTINCT query_id) AS n FROM ({ORACLE_SQL["code_search"]})),
k AS (SELECT item_id AS query_id, id, rank FROM benchmark JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({ORACLE_SQL["code_search"]})) c ON c.query_id = item_id % (SELECT max(query_id) + 1 FROM ({ORACLE_SQL["code_search"]})) WHERE rank <= 10),
l AS (SELECT l_orderkey AS evidence_id, min(l_partkey) AS part, min(l_suppkey) AS subject FROM lineitem GROUP BY 1), dd AS (SELECT max(doc_id) + 1 AS n FROM documents),
c AS (SELECT o_orderkey AS evidence_id, o_orderkey % n AS memory_id, {_RELATION} AS relationship, state, CASE WHEN state IN ('current', 'moved', 'changed') THEN part END AS artifact_id, subject FROM orders CROSS JOIN dd JOIN ({ORACLE_SQL["drift_classification"]}) s ON s.evidence_id = o_orderkey LEFT JOIN l ON l.evidence_id = o_orderkey),
h AS (SELECT * FROM (SELECT m.query_id, m.rank, c.*, row_number() OVER (PARTITION BY m.query_id ORDER BY m.rank, c.evidence_id) AS position FROM m JOIN c ON c.memory_id = m.id) WHERE position <= 25),
x AS (SELECT query_id, id, 0 AS part, min(position) AS place FROM (SELECT query_id, artifact_id AS id, position FROM h WHERE artifact_id IS NOT NULL) GROUP BY 1, 2), y AS (SELECT * FROM x UNION ALL SELECT query_id, id, 1, rank FROM k ANTI JOIN x USING (query_id, id)),
i AS ({ORACLE_SQL["contextual_impact"]}), g AS (SELECT query_id, min(coalesce(list_position(['affected', 'possibly_affected', 'unknown', 'unaffected'], coalesce(verdict, 'unknown')), 3)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, evidence_id) AS n FROM h WHERE subject IS NOT NULL) s LEFT JOIN i USING (subject) WHERE n <= 5 GROUP BY 1),
f AS (SELECT query_id, position * 2 AS place, 'anchor:' || evidence_id || ':contradicts' AS item FROM h WHERE relationship = 'contradicts' UNION ALL SELECT query_id, position * 2 + (relationship = 'contradicts')::INT, 'anchor:' || evidence_id || ':' || state FROM h WHERE state NOT IN ('current', 'moved') UNION ALL SELECT query_id, 10000, 'contextual-impact:' || ['affected', 'possibly_affected', 'unknown', 'unaffected'][g] FROM g WHERE g < 4),
packet AS (SELECT m.query_id, 'memory' AS kind, row_number() OVER (PARTITION BY m.query_id ORDER BY h.memory_id IS NULL, m.rank) AS position, m.id::VARCHAR AS item FROM m LEFT JOIN (SELECT DISTINCT query_id, memory_id FROM h) h ON h.query_id = m.query_id AND h.memory_id = m.id
UNION ALL SELECT query_id, 'code', p, id::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place, id) AS p FROM y) WHERE p <= 10
UNION ALL SELECT query_id, 'anchor', position, evidence_id || ':' || relationship || ':' || state FROM h UNION ALL SELECT query_id, 'conflict', row_number() OVER (PARTITION BY query_id ORDER BY place), item FROM f)"""


def packets(spark: SparkSession, d: str) -> DataFrame:
    memory_hits = retrieval.hybrid(spark, d).select("query_id", "id", "rank").where(F.col("rank") <= J.MEMORIES)
    found = saved(code._code_search(spark, d, lexical=True))
    asks = found.agg(F.max("query_id") + 1).first()[0]  # the code search's words are a few
    best = R.ranked(found, F.desc("score"), F.col("id"), limit=J.CODE).withColumnRenamed("query_id", "_word")
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % asks).alias("_word"))
    code_hits = passages.join(best, "_word").select("query_id", "id", "rank")
    n = table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0]
    relation = F.when(F.col("o_orderpriority") == "1-URGENT", "contradicts").when(F.col("o_orderpriority") == "2-HIGH", "supports").otherwise("implements")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_orderkey") % n).alias("memory_id"), relation.alias("relationship"))
    memory_hits = saved(memory_hits)
    # only citations of ranked memories can be anchors: the others' lines are read, but neither moved nor judged
    cited = saved(orders.join(F.broadcast(memory_hits.select(F.col("id").alias("memory_id")).distinct()), "memory_id", "left_semi"))
    lines = _of(table(spark, d, "lineitem"), "l_orderkey", cited.select(F.col("evidence_id").alias("l_orderkey")))
    first = lines.groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("subject"))
    citations = cited.join(code.drift_of(lines, cited.select("evidence_id")), "evidence_id").join(first, "evidence_id", "left")
    citations = citations.withColumn("artifact_id", F.when(F.col("state").isin("current", "moved", "changed"), F.col("part"))).drop("part")

    def impact(subjects: DataFrame) -> DataFrame:
        return code.impact_of(_of(table(spark, d, "lineitem"), "l_suppkey", subjects.select(F.col("subject").alias("l_suppkey"))))

    return J.packet(memory_hits, code_hits, citations, impact)


#: Keys that are broadcast at most.
MOST_BROADCAST = 1_000_000


def _of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the wanted ones; few are broadcast, so that the others stay where they are read."""
    wanted = saved(wanted.distinct())
    return rows.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, key, "left_semi")


@query("joint_context", f"WITH {_PACKET} SELECT query_id, kind, position, item FROM packet")
def joint_context(spark: SparkSession, d: str) -> DataFrame:
    """Per passage: memories, code, anchors and conflicts, anchored ones first."""
    return packets(spark, d)


@query("joint_delivery", f"""WITH {_PACKET} SELECT query_id, CASE WHEN count(*) FILTER (kind = 'memory') > 0 AND count(*) FILTER (kind = 'code') > 0 THEN 'both' WHEN count(*) FILTER (kind = 'memory') > 0 THEN 'memory-only' WHEN count(*) FILTER (kind = 'code') > 0 THEN 'code-only' ELSE 'abstain' END AS route,
count(*) FILTER (kind = 'memory') AS n_memory, count(*) FILTER (kind = 'code') AS n_code, count(*) FILTER (kind = 'anchor') AS n_anchor, count(*) FILTER (kind = 'conflict') AS n_conflict FROM packet GROUP BY 1""")
def joint_delivery(spark: SparkSession, d: str) -> DataFrame:
    return J.delivered(packets(spark, d))

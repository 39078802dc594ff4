"""The data model over the driver's tables: memories, tenancy, episodes, links and artifacts.

Columns that the tables lack are derived deterministically (SQL twins stand beside each view):

memories      one a document; workspace = doc_id mod 5, owner = doc_id mod 25, every fourth one private,
              updated a minute after the one before
tenancy       users = nations, workspaces = regions, agents = suppliers (owned by their nation); users
              are members of their region, every seventh membership is not active; grants: an agent's
              region, write for every third agent, read for the others, every eleventh withdrawn
observations  conversation turns
links         distinct part-supplier pairs of lineitem, weight = orders that share them
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

MEMORIES_SQL = """SELECT doc_id AS id, doc_id % 5 AS workspace_id, doc_id % 25 AS owner_id,
    CASE WHEN doc_id % 4 = 0 THEN 'private' ELSE 'shared' END AS scope, text AS content, lang, source,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS updated_at FROM documents"""
MEMBERSHIPS_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS user_id, CAST(n_regionkey AS BIGINT) AS workspace_id,
    CASE WHEN n_nationkey % 7 = 6 THEN 'left' ELSE 'active' END AS status FROM nation"""
AGENTS_SQL = """SELECT s_suppkey AS agent_id, CAST(s_nationkey AS BIGINT) AS owner_id, CASE WHEN s_suppkey % 13 = 0 THEN 'disabled' ELSE 'active' END AS status FROM supplier"""
GRANTS_SQL = """SELECT s_suppkey AS agent_id, CAST(n_regionkey AS BIGINT) AS workspace_id, CASE WHEN s_suppkey % 3 = 0 THEN 'write' ELSE 'read' END AS permission,
    CASE WHEN s_suppkey % 11 = 0 THEN 'withdrawn' ELSE 'active' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
LINKS_SQL = """SELECT l_partkey AS source_id, l_suppkey + 1000000000 AS target_id, count(*) AS weight FROM lineitem GROUP BY 1, 2"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 5).alias("workspace_id"),
        (F.col("doc_id") % 25).alias("owner_id"),
        F.when(F.col("doc_id") % 4 == 0, "private").otherwise("shared").alias("scope"),
        F.col("text").alias("content"),
        "lang",
        "source",
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("updated_at"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_regionkey").cast("long").alias("workspace_id"), F.when(F.col("n_nationkey") % 7 == 6, "left").otherwise("active").alias("status"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("agent_id"), F.col("s_nationkey").cast("long").alias("owner_id"), F.when(F.col("s_suppkey") % 13 == 0, "disabled").otherwise("active").alias("status"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("agent_id"), F.col("n_regionkey").cast("long").alias("workspace_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "write").otherwise("read").alias("permission"), F.when(F.col("s_suppkey") % 11 == 0, "withdrawn").otherwise("active").alias("status"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier links; suppliers get ids apart from the parts'."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("source_id"), (F.col("l_suppkey") + F.lit(1_000_000_000)).alias("target_id")).agg(F.count("*").alias("weight"))

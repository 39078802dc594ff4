"""Authorisation before ranking: who may read or write which rows, as joins and boolean columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_members(memberships: DataFrame) -> DataFrame:
    """(user_id, workspace_id) of active memberships."""
    return memberships.where("status = 'active'").select("user_id", "workspace_id").distinct()


def agent_access(agents: DataFrame, grants: DataFrame, memberships: DataFrame, permission: str | None = None) -> DataFrame:
    """(agent_id, owner_id, workspace_id) that active agents reach: an active grant, and an active membership of their owner."""
    granted = grants.where("status = 'active'")
    if permission is not None:
        granted = granted.where(F.col("permission") == permission)
    reach = agents.where("status = 'active'").join(granted.select("agent_id", "workspace_id"), "agent_id")
    member = active_members(memberships).withColumnRenamed("user_id", "owner_id")
    return reach.join(member, ["owner_id", "workspace_id"], "left_semi").select("agent_id", "owner_id", "workspace_id")


def may_read(user_id, scope="scope", owner="owner_id") -> F.Column:
    return (F.col(scope) == "shared") | (F.col(owner) == user_id)


def visible(memories: DataFrame, memberships: DataFrame) -> DataFrame:
    """Each user's readable memories: the rows with the user_id that may read them."""
    return memories.join(active_members(memberships), "workspace_id").where(may_read(F.col("user_id")))


def visible_to(memories: DataFrame, memberships: DataFrame, user_id: int) -> DataFrame:
    """The memories that one user may read."""
    mine = active_members(memberships).where(F.col("user_id") == user_id).select("workspace_id")
    return memories.where(may_read(F.lit(user_id))).join(mine, "workspace_id", "left_semi")


def with_both_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose source and target are both among ``nodes`` (column id)."""
    return links.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def rights(memberships: DataFrame) -> DataFrame:
    """Memberships (status, role) with what their holder may do in the workspace, as boolean columns."""
    active, role = F.col("status") == "active", F.col("role")
    return memberships.withColumns({
        "manages": active & (role == "owner"), "evaluates": active & role.isin("owner", "admin"), "reviews": active & (role != "guest"),
        "reads_code": active, "writes_code": active & (role != "guest"),
    })


def connected(links: DataFrame) -> DataFrame:
    """Links (source_id, target_id, kind, weight) as they are stored: weight within [0, 1], ``related`` without a kind, none to itself."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0))))
    return links.where("source_id <> target_id").select("source_id", "target_id", F.coalesce("kind", F.lit("related")).alias("kind"), weight.alias("weight"))

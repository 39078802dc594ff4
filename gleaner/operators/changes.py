"""State transitions as joins and windows: change feeds, lease claims, retry delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_feed(before: DataFrame, after: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, event_type, before_sha256, after_sha256) of keys whose content was created, updated or deleted."""
    digest = lambda df, name: df.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias(name))
    both = digest(before, "before_sha256").join(digest(after, "after_sha256"), keys, "full").where(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))
    kind = F.when(F.col("before_sha256").isNull(), "created").when(F.col("after_sha256").isNull(), "deleted").otherwise("updated")
    return both.select(*keys, kind.alias("event_type"), "before_sha256", "after_sha256")


def claimed(jobs: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """The first job of each lane with its attempt counted up."""
    k = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    return jobs.withColumn("_k", k).where("_k = 1").drop("_k").withColumn("attempt", F.col("attempt") + 1)


def backoff_seconds(attempt: Column, base: int = 30, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))


def field_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_type, changed_fields) of rows created, updated or deleted; the fields in the tables' order, comma-joined."""
    fields = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    both = side(before, "_b").join(side(after, "_a"), keys, "full")
    changed = [F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in fields]
    kind = F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "deleted").otherwise("updated")
    every = F.when(F.col("_b").isNull() | F.col("_a").isNull(), F.lit(",".join(fields))).otherwise(F.concat_ws(",", *changed))
    return both.select(*keys, kind.alias("event_type"), every.alias("changed_fields")).where("changed_fields <> ''")

"""Keyed writes expressed as rewrites: insert what is missing, upsert with a guard, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` (one a key) whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], when: Column | None = None) -> DataFrame:
    """``old`` with rows of ``new`` (one a key): a key both have is replaced where ``when`` holds.

    ``when`` may name columns of both sides as ``old.x`` and ``new.x``; null counts as false.
    """
    o, n = old.withColumn("_old", F.lit(True)).alias("old"), new.withColumn("_new", F.lit(True)).alias("new")
    same = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    take = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)))
    cols = [F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in old.columns]
    return o.join(n, same, "full").select(*cols)


def export_manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rows, checksum): the checksum adds up row hashes, so any order and partitioning gives the same."""
    out = None
    for name, df in parts.items():
        digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(digest, 1, 13), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")).select(F.lit(name).alias("part"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


def replaced(rows: DataFrame, where: str, by: str) -> None:
    """Overwrite those partitions (by ``by``) of a Parquet table that ``rows`` has rows for; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(where)

"""An append-only table of keyed versions: deltas are appended, read as of a version, and merged into a base now and then.

Layout: ``base/version=k`` holds every key's last row up to k, ``delta/version=k`` the rows that version k added. A version is written
under its number, so writing it again replaces it, and readers of earlier versions never see it. Merging leaves the deltas where they are until
``expire`` drops those that a base holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dropped, shuffles_dropped


def _versions(spark: SparkSession, where: str, part: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{part}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    # a folder without its mark is a write that was not finished
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{part}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def append(rows: DataFrame, where: str, version: int) -> None:
    """Add the rows that ``version`` changes."""
    with shuffles_dropped(rows.sparkSession):
        rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{where}/delta/version={version}")


def as_of(spark: SparkSession, where: str, version: int, keys: list[str]) -> DataFrame:
    """Each key's last row up to ``version``: of the newest base that is not later, and the deltas after it."""
    bases = [v for v in _versions(spark, where, "base") if v <= version]
    base = bases[-1] if bases else None
    parts = [f"{where}/delta/version={v}" for v in _versions(spark, where, "delta") if (base is None or v > base) and v <= version]
    if base is not None:
        parts.insert(0, f"{where}/base/version={base}")
    if not parts:
        raise ValueError(f"nothing is written up to version {version}")
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in parts))
    others = [c for c in rows.columns if c not in keys]
    if base is not None and len(parts) == 1:
        return rows.select(*keys, *others)  # a base has every key once
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "version").alias("r")).select(*keys, "r.*")


def merge(spark: SparkSession, where: str, version: int, keys: list[str]) -> None:
    """Write the base of ``version``."""
    with shuffles_dropped(spark):
        as_of(spark, where, version, keys).write.mode("overwrite").parquet(f"{where}/base/version={version}")


def expire(spark: SparkSession, where: str, version: int) -> None:
    """Drop deltas and bases before the base of ``version``; earlier versions can be read no longer."""
    if version not in _versions(spark, where, "base"):
        raise ValueError(f"version {version} has no base")
    for part, last in (("delta", version), ("base", version - 1)):
        for v in _versions(spark, where, part):
            if v <= last:
                dropped(spark, f"{where}/{part}/version={v}")

"""Files and indexes checked against what they should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def inspected(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, each read whole by one task."""
    files = spark.read.format("binaryFile").load(where)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of expected files (key, bytes, sha256) against inspected ones: verified, mismatch, missing, or unexpected."""
    e = expected.select(key, F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    both = found.select(key, "bytes", "sha256", F.lit(True).alias("_found")).join(e.withColumn("_wanted", F.lit(True)), key, "full")
    same = (F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_s"))
    return both.select(key, F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "unexpected").when(same, "verified").otherwise("mismatch").alias("outcome"))


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows differ between two tables as bags, whatever their order.

    Each side adds up two hashes of its rows by key, so rows move as partial sums and only once; null values are equal to each other.
    """
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        raise ValueError("the tables have different columns")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))
    sums = lambda df, name: df.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).alias(name))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = sums(left, "_l").alias("l").join(sums(right, "_r").alias("r"), same, "full")
    return both.where(~F.col("_l").eqNullSafe(F.col("_r"))).select(*(F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys))


def index_outcomes(expected: DataFrame, stored: DataFrame, revision: str) -> DataFrame:
    """(id, outcome, ordinal) of memories whose stored chunks are to be reused: ``exact``, ``incomplete``, or ``chunk`` with the first that fails.

    expected: id, ordinal, chunk; stored: the same and revision, null where a chunk has no vector. Bag equality settles
    the exact ones; chunks are compared one by one for the others only.
    """
    sound = stored.where(F.col("revision") == revision).select("id", "ordinal", "chunk")
    bad = differing(expected, sound, ["id"])
    w = Window.partitionBy("id")
    want = expected.join(bad, "id", "left_semi").select("id", "ordinal", "chunk", F.count("*").over(w).alias("_n"))
    have = stored.join(bad, "id", "left_semi").select("id", "ordinal", F.col("chunk").alias("_chunk"), "revision", F.count("*").over(w).alias("_m"))
    fails = ~F.col("chunk").eqNullSafe(F.col("_chunk")) | ~F.col("revision").eqNullSafe(F.lit(revision))
    found = want.join(have, ["id", "ordinal"], "full").groupBy("id").agg(F.max("_n").alias("n"), F.max("_m").alias("m"), F.min(F.when(fails, F.col("ordinal"))).alias("at"))
    detail = found.select("id", F.when(F.col("n").eqNullSafe(F.col("m")), "chunk").otherwise("incomplete").alias("outcome"), F.when(F.col("n").eqNullSafe(F.col("m")), F.col("at")).alias("ordinal"))
    exact = expected.select("id").distinct().join(bad, "id", "left_anti").select("id", F.lit("exact").alias("outcome"), F.lit(None).cast("int").alias("ordinal"))
    return exact.unionByName(detail)

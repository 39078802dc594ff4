"""Evaluation of rankings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, expected: DataFrame, forbidden: DataFrame, limit: int) -> DataFrame:
    """Per query: recall, reciprocal rank, nDCG at ``limit``, and whether no forbidden id was retrieved at any rank.

    hits (query_id, id, rank), expected (query_id, id), forbidden (id); queries without expected ids score 0.
    """
    want = expected.distinct().withColumn("hit", F.lit(1))
    n = expected.distinct().groupBy("query_id").agg(F.count("*").alias("n_expected"))
    judged = hits.select("query_id", "id", "rank").join(want, ["query_id", "id"], "left").join(forbidden.select("id").distinct().withColumn("bad", F.lit(1)), "id", "left")
    inside = F.col("hit").isNotNull() & (F.col("rank") <= limit)
    got = judged.groupBy("query_id").agg(
        F.count(F.when(inside, 1)).alias("n_found"), F.min(F.when(inside, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"), F.count("bad").alias("n_bad"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_expected", F.lit(limit)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return got.join(n, "query_id", "left").select(
        "query_id", F.coalesce("n_expected", F.lit(0)).cast("long").alias("n_expected"),
        F.round(F.coalesce(F.col("n_found") / F.col("n_expected"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.when(F.col("n_expected") > 0, F.col("dcg") / ideal), F.lit(0.0)), 6).alias("ndcg"),
        (F.col("n_bad") == 0).alias("isolated"),
    )


def token_overlap(predicted: DataFrame, reference: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """Token F1 of each key's predicted and reference answers by multiset intersection (keys without overlap are absent)."""
    counted = lambda df: df.select(*keys, F.explode(F.split(text, " ")).alias("word")).where("word <> ''").groupBy(*keys, "word").agg(F.count("*").alias("n"))
    p, r = counted(predicted), counted(reference)
    lengths = lambda df, name: df.groupBy(*keys).agg(F.sum("n").alias(name))
    common = p.join(r.withColumnRenamed("n", "m"), [*keys, "word"]).groupBy(*keys).agg(F.sum(F.least("n", "m")).alias("common"))
    got = common.join(lengths(p, "n_predicted"), keys).join(lengths(r, "n_reference"), keys)
    return got.withColumn("f1", 2.0 * F.col("common") / (F.col("n_predicted") + F.col("n_reference")))

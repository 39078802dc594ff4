"""Answers from evidence: whole or windowed memories, versioned facts, frames, chains of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_HOPS = 6


def answer_evidence(chunks: DataFrame, anchors: DataFrame, top: int, neighbors: int) -> DataFrame:
    """(query_id, id, evidence, n_chunks, whole): what a memory (id) says to a query, in order, nothing between.

    chunks: id, ordinal, chunk; anchors: query_id, id, ordinal, rank within the query. A memory of at most
    top * (2 * neighbors + 1) chunks counts whole; of others the windows around their ``top`` best anchors.
    """
    place = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank"))
    best = anchors.withColumn("_k", place).where(F.col("_k") <= top)
    sizes = chunks.groupBy("id").agg(F.count("*").alias("_n"))
    asked = best.join(sizes, "id").withColumn("whole", F.col("_n") <= top * (2 * neighbors + 1))
    near = asked.where("not whole").select("query_id", "id", F.explode(F.sequence(F.col("ordinal") - neighbors, F.col("ordinal") + neighbors)).alias("ordinal")).distinct()
    windows = chunks.join(near, ["id", "ordinal"]).select("query_id", "id", "ordinal", "chunk", F.lit(False).alias("whole"))
    entire = chunks.join(asked.where("whole").select("query_id", "id").distinct(), "id").select("query_id", "id", "ordinal", "chunk", F.lit(True).alias("whole"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    got = windows.unionByName(entire).groupBy("query_id", "id", "whole").agg(parts.alias("p"))
    return got.select("query_id", "id", F.concat_ws("", F.transform("p", lambda p: p["chunk"])).alias("evidence"), F.size("p").cast("long").alias("n_chunks"), "whole")


def numbered_facts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, serial, fact) of the lines ``n. fact`` of each text; of a repeated serial the first line counts."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    pattern = r"^\s*(\d+)\.\s+(.+?)\s*$"
    parsed = lines.where(F.col("line").rlike(pattern)).select(key, "at", F.regexp_extract("line", pattern, 1).cast("long").alias("serial"), F.regexp_extract("line", pattern, 2).alias("fact"))
    return parsed.groupBy(key, "serial").agg(F.min_by("fact", "at").alias("fact"))


def framed_answers(facts: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame_id, answer, serial, n): what stands in a frame (prefix, suffix) in the fact with the highest serial.

    A fact meets the frames whose whole prefix it begins with: it is cut at each length that a prefix has, and joined by that beginning.
    """
    lengths = frames.agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # one row of distinct lengths
    begun = facts.crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths")).where(F.length("fact") > F.col("_n"))
    met = begun.withColumn("prefix", F.substring("fact", F.lit(1), F.col("_n"))).drop("_lengths", "_n").join(frames, "prefix")
    fits = met.where(F.col("fact").endswith(F.col("suffix")) & (F.length("fact") > F.length("prefix") + F.length("suffix")))
    answer = F.substring("fact", F.length("prefix") + 1, F.length("fact") - F.length("prefix") - F.length("suffix"))
    return fits.groupBy("frame_id").agg(F.max_by(answer, "serial").alias("answer"), F.max("serial").alias("serial"), F.count("*").alias("n"))


def hops(questions: DataFrame, facts: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(question_id, answer, n_hops): chains of facts, each hop asking about the answer before.

    questions: question_id, subject, relations (an array); facts: subject, relation, answer, serial, of which the highest serial
    counts. Chains that break give no answer, and those of more than ``most`` hops none either.
    """
    known = facts.groupBy("subject", "relation").agg(F.max_by("answer", "serial").alias("_next"))
    now = questions.where(F.size("relations").between(1, most)).select("question_id", F.col("subject").alias("answer"), "relations")
    for hop in range(most):
        asked = F.try_element_at("relations", F.lit(hop + 1))
        open_, done = now.where(asked.isNotNull()), now.where(asked.isNull())
        step = open_.withColumn("relation", asked).join(known.withColumnRenamed("subject", "answer"), ["answer", "relation"])
        now = done.unionByName(step.select("question_id", F.col("_next").alias("answer"), "relations"))
    return now.select("question_id", "answer", F.size("relations").cast("long").alias("n_hops"))

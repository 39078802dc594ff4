"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled order (a seeded hash of the document), and a source
is served again from the start up to ``max_passes`` times. A document is served in packets of at most PACKET words;
a packet's virtual finish time is its source's cumulative words up to its end divided by the source's target.
All packets of all sources are put in one order by virtual finish time, their words are summed
up in that order, and the mix ends where the sum reaches the total budget: whole packets before that point
are taken, the packet there in part, none after. So every source's words come within a packet of
its target, and what each document gives follows from how far its source was served.

The global order is a range partitioning by virtual time: words per slice of virtual time
are summed (two-level running sums), and only the slice in which the budget ends is sorted. The shuffled
orders are summed in the same way, in slices of the hash. The slices are as many as the square root of the
rows, so a source that holds most rows is still dealt over many tasks. Equal rows (doc_id, source
and text alike) are one row with a count until the end, so that no group of them meets in one task. The only single-task
steps rank the sources and sum over slices, one row each.

Defined cases: a null text has no words; documents without words are in no mix (taken 0); a null
source is a source of its own and comes last; null doc_ids are ordered by their text's hash; equal rows
are served one after the other, so which of them gives what can't be told. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, saved, small_batches, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
SEED = 2024
#: Words of a packet at most, and of equal rows or packets how many one task makes out of one row.
PACKET, SPREAD = 16, 1 << 16


def word_count(text) -> F.Column:
    """Words by the contract's pattern, null texts 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES, budget: float | None = None) -> DataFrame:
    """Target of each source (rows: source, source_size) by water-filling.

    The level L with sum(min(L * weight, cap)) = budget is found in one pass over the sources by
    cap / weight: those below the level stop at their cap, the rest share what remains by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_k", rank).withColumn("weight", w).withColumn("_cap", F.col("source_size") * float(max_passes))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_k")
    total = Window.partitionBy()
    aim = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(total).cast("double")
    level = (
        ranked.withColumn("_aim", aim)
        .withColumn("_below", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_aim") - F.col("_below")) / F.col("_rest"))
        # the first source, in order, whose cap is not below the level that would hold from it on
        .withColumn("_lowest", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_k", "_level"))).over(total)["_level"])
    )
    got = F.coalesce(F.least(F.col("_lowest") * F.col("weight"), F.col("_cap")), F.col("_cap"))
    return level.select("source", "source_size", "weight", got.alias("target"))


def _spread(rows: DataFrame, n, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``name``; what a row gives beyond SPREAD is dealt over tasks."""
    rows = rows.withColumn("_n", n.cast("long"))
    few = rows.where(F.col("_n").between(1, SPREAD)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = rows.where(F.col("_n") > SPREAD).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SPREAD)))).repartition("_c")
    last = F.least(F.col("_n"), (F.col("_c") + 1) * SPREAD) - 1
    many = many.withColumn(name, F.explode(F.sequence(F.col("_c") * SPREAD, last))).drop("_c")
    return few.unionByName(many).drop("_n")


def _order_key(seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_passes: int = MAX_PASSES, seed: int = SEED, row: F.Column | None = None) -> DataFrame:
    """One row for equal documents: size, their number (copies), source's size and target, place in the queue.

    ``begin`` is the source's words before the first of them in the shuffled order. ``row`` tells
    documents apart whose other columns differ.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order_key(seed).alias("_key"), (F.lit(0).cast("long") if row is None else row).alias("_row"))
    # a null source is told apart by a flag, so plain keys do
    rows = rows.groupBy("doc_id", "source", "size", "_key", "_row").agg(F.count("*").alias("copies"))
    rows = saved(rows.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()))
    slices = max(1, math.isqrt(rows.count()))
    # equal slices of the hash range, in order
    rows = (
        rows.withColumn("_o", F.shiftrightunsigned(F.col("_key"), 1))
        .withColumn("_b", F.floor(F.shiftrightunsigned(F.col("_key"), 33).cast("double") / F.lit(float(2**31)) * slices).cast("int"))
    )
    words = F.col("size") * F.col("copies")
    sums = saved(rows.groupBy("_s", "_null", "_b").agg(F.first("source").alias("source"), F.sum(words).alias("_sum")))
    aims = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_passes)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "source_size", "target")
    before = Window.partitionBy("_s", "_null").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.select("_s", "_null", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")).join(aims, ["_s", "_null"])
    within = Window.partitionBy("_s", "_null", "_b").orderBy("_o", "_key", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    queued = rows.withColumn("_in", F.coalesce(F.sum(words).over(within), F.lit(0))).join(at, ["_s", "_null", "_b"])
    return saved(queued.select("doc_id", "source", "_s", "_null", "_key", "_row", "size", "copies", "source_size", "target", (F.col("_before") + F.col("_in")).alias("begin")))


def packets(queued: DataFrame, max_passes: int = MAX_PASSES, until: float | None = None) -> DataFrame:
    """(source, words, end, virtual_finish) of every packet that starts before the virtual time ``until``."""
    rows = queued.where("size > 0 and target > 0").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    start = F.col("_p") * F.col("source_size") + F.col("begin")
    if until is not None:
        rows = rows.where(start < F.col("target") * until)
    total = F.col("size") * F.col("copies")
    rows = _spread(rows.select("_s", "_null", "target", start.alias("_start"), total.alias("_all")), F.ceil(F.col("_all") / PACKET), "_k")
    words = F.least(F.lit(PACKET), F.col("_all") - F.col("_k") * PACKET)
    end = F.col("_start") + F.col("_k") * PACKET + words
    return rows.select("_s", "_null", words.cast("long").alias("words"), end.alias("end"), (end / F.col("target")).alias("virtual_finish"))


def served(queued: DataFrame, max_passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """(source, served): how many words of each source the global order takes before the budget is reached."""
    if budget is None:
        budget = queued.agg(F.sum(F.col("size") * F.col("copies")).alias("n")).first()["n"] or 0
    slices = 4 * max(1, math.isqrt(queued.count()))
    found = None
    # targets add up to the budget, so it is reached near virtual time 1, unless packets are large against the targets
    for until in (2.0, None):
        slice_of = F.least(F.lit(2 * slices), F.floor(F.col("virtual_finish") * slices)).cast("int")
        cut = packets(queued, max_passes, until).withColumn("_b", slice_of)
        sums = saved(cut.groupBy("_b", "_s", "_null").agg(F.sum("words").alias("words"), F.max("end").alias("end")))
        order = Window.orderBy("_b")
        found = sums.groupBy("_b").agg(F.sum("words").alias("_w")).withColumn("_sum", F.sum("_w").over(order)).where(F.col("_sum") >= budget).orderBy("_b").select("_b", (F.col("_sum") - F.col("_w")).alias("_before")).first()
        if found is not None:
            break
    if found is None:  # nothing to serve, or less than the budget
        return sums.groupBy("_s", "_null").agg(F.max("end").alias("served"))
    # the slice that the budget ends in, packet by packet in the global order
    order = Window.orderBy("virtual_finish", "_null", "_s").rowsBetween(Window.unboundedPreceding, -1)
    there = cut.where(F.col("_b") == found["_b"]).withColumn("_left", F.lit(budget - found["_before"]) - F.coalesce(F.sum("words").over(order), F.lit(0)))
    there = there.where("_left > 0").select("_s", "_null", (F.col("end") - F.greatest(F.lit(0), F.col("words") - F.col("_left"))).alias("end"))
    whole = sums.where(F.col("_b") < found["_b"]).select("_s", "_null", "end")
    return whole.unionByName(there).groupBy("_s", "_null").agg(F.max("end").alias("served"))


def _one_by_one(queued: DataFrame, max_passes: int, budget: int | None) -> DataFrame:
    """Every document with its place (``begin``) and how far its source is served."""
    far = queued.join(served(queued, max_passes, budget), ["_s", "_null"], "left").withColumn("served", F.coalesce("served", F.lit(0)))
    return _spread(far, F.col("copies"), "_k").withColumn("begin", F.col("begin") + F.col("_k") * F.col("size"))


def _taken(start) -> F.Column:
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - start)).cast("long")


def services(queued: DataFrame, max_passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """The mix: a row for each time a document is taken, with its virtual finish time and the words taken."""
    passes = _one_by_one(queued, max_passes, budget).where("size > 0").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    start = F.col("_p") * F.col("source_size") + F.col("begin")
    return passes.select("doc_id", "_key", "_row", "_p", "size", ((start + F.col("size")) / F.col("target")).alias("virtual_finish"), _taken(start).alias("words_taken")).where("words_taken > 0")


def report(queued: DataFrame, max_passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """Per document the words that the mix takes, repeats counted."""
    rows = _one_by_one(queued, max_passes, budget)
    took = sum((_taken(F.lit(p) * F.col("source_size") + F.col("begin")) for p in range(max_passes)), F.lit(0))
    first = F.when(F.col("target") > 0, (F.col("begin") + F.col("size")) / F.col("target"))
    return rows.select("doc_id", "size", "source_size", "target", took.cast("long").alias("taken"), first.alias("virtual_finish"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(queue(table(spark, sf_dir, "documents")))


_nth = re.compile(WORD)


def cut(text: str, words: int) -> str:
    """The text up to the end of its ``words``-th word."""
    for i, m in enumerate(_nth.finditer(text), 1):
        if i == words:
            return text[: m.end()]
    return text


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents in the mix's order, a row for each time one is taken.

    The document of each source that its last packet cuts keeps the words before it. Documents without
    words are in no mix. Texts move twice: to their services, and into the mix's order.
    """
    small_batches(spark)
    columns = docs.columns
    of_row = F.xxhash64(*columns)
    order = "virtual_finish", "_key", "doc_id", "_row", "_p"
    mix = services(queue(docs, row=of_row)).select(*(F.col(c).alias(f"_gleaner_{c.strip('_')}") for c in ("doc_id", "_key", "_row", "_p", "virtual_finish", "size", "words_taken")))
    keys = ["_gleaner_key", "_gleaner_row"]
    once = docs.withColumn("_gleaner_key", _order_key(SEED)).withColumn("_gleaner_row", of_row).dropDuplicates(keys)
    mix = once.join(mix.drop("_gleaner_doc_id"), keys).orderBy(*(f"_gleaner_{c.strip('_')}" for c in order if c != "doc_id"))
    mix = mix.select(*columns, "_gleaner_size", "_gleaner_words_taken")
    at, size_at, took_at = columns.index("text"), len(columns), len(columns) + 1
    chars = columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns
            short = [i for i, (s, k) in enumerate(zip(cols[size_at].to_pylist(), cols[took_at].to_pylist())) if k < s]
            if short:
                texts, took = cols[at].to_pylist(), cols[took_at].to_pylist()
                for i in short:
                    texts[i] = cut(texts[i], took[i])
                cols[at] = pa.array(texts, pa.string())
                if chars is not None:
                    new = cols[chars].to_pylist()
                    for i in short:
                        new[i] = len(texts[i])
                    cols[chars] = pa.array(new, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols[: len(columns)], names=columns)

    return mix.mapInArrow(run, T.StructType([docs.schema[c] for c in columns]))

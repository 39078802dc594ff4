"""Filter interaction audit over a packed bitmap index.

Every document becomes a row of flags: the filters that it fails, its labels, its part (source). A block of rows is packed into
NumPy bitsets, one for each filter, label and part; for each subset of filters that can come before a filter, AND-NOT and
popcount give how many documents of the part still stand, fall there, or have fallen before. Bitsets of a part are
narrowed to the bytes where it has a row, so many parts cost no more than few. The counts by (part, subset, filter), 80 rows
a part and block at most, are summed by a shuffle, and the report of every order of the filters reads its steps from these sums.

Texts are read once and never moved: the flags carry a sha256 digest. The smallest doc_id of each digest comes from an aggregation that
combines before its shuffle. Digests that hold a thousandth of all rows or more, at most a thousand by that, are joined by broadcast,
the rest by a shuffle in which no key is large. Rows without doc_id are dealt over all partitions of the join with labels.

Defined cases: a null text is empty, a null source is the part ''. A null doc_id has no labels, never repeats a smaller one's text and
is no smaller doc_id itself; rows with equal doc_id and text do not repeat each other. Of a document's repeated labels any that
is 1 counts. A word is counted in bytes as it is; extra columns are ignored; an empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, saved, small_batches, table

FILTERS = "ABCDE"
#: Bits of a row beyond those of the filters.
GOOD, TOXIC = 32, 64
#: Rows of a block of the index, and the share of all rows (one in so many) from which a digest counts as frequent.
BLOCK, FREQUENT = 1 << 16, 1000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_byte = np.arange(256)
UPPER = (_byte >= 65) & (_byte <= 90)
LEADS = (_byte & 0xC0) != 0x80
MARKS = np.isin(_byte, [ord(c) for c in "#$%&*|"])


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself."""
    words = text.split()  # bytes split at ASCII white space only
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    fails = len(words) < 200
    fails |= (100 * len(set(words)) < 50 * len(words)) << 1
    fails |= bool(100 * octets[UPPER].sum() > 2 * octets[LEADS].sum()) << 2
    return int(fails) | bool(octets[MARKS].any()) << 3


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest) of every document; filter E is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("audit", None, dict)  # lets go of what other operators kept
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            fails = pa.array([own_failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fails, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "fails", "digest"])

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with the bit of filter E: another row of a smaller doc_id has the same digest."""
    least = rows.count() // FREQUENT + 1
    firsts = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    frequent = firsts.where(F.col("_n") >= least).select("digest", "_first")  # at most FREQUENT rows
    rare = firsts.where(F.col("_n") < least).select("digest", F.col("_first").alias("_rare"))
    joined = rows.join(F.broadcast(frequent), "digest", "left")
    # a frequent digest has no partner here: its rows are dealt by doc_id
    key = F.when(F.col("_first").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.coalesce("doc_id", F.lit(0)))))
    joined = joined.withColumn("_key", key).join(rare.withColumnRenamed("digest", "_key"), "_key", "left")
    again = F.coalesce(F.col("doc_id") > F.coalesce("_first", "_rare"), F.lit(False))
    return joined.select("doc_id", "part", F.col("fails").bitwiseOR(F.when(again, 16).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits): failures and labels of every row."""
    bit = lambda c, b: F.max(F.when(F.col(c) == 1, b).otherwise(0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("_labels"))
    # rows without doc_id match nothing, and the second key deals them out
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    joined = rows.withColumn("_salt", salt).join(known.withColumn("_salt", F.lit(0).cast("long")), ["doc_id", "_salt"], "left")
    return joined.select("part", F.col("fails").bitwiseOR(F.coalesce("_labels", F.lit(0))).alias("bits"))


_ones = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _count(bits: np.ndarray) -> int:
    return int(_ones[bits].sum())


def block_counts(part: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
    """(part's index, subset before, filter, then COUNTS) of a block: parts as indexes, rows' bits."""
    fails = [np.packbits(bits & (1 << f) > 0) for f in range(5)]
    good, toxic = np.packbits(bits & GOOD > 0), np.packbits(bits & TOXIC > 0)
    order = np.argsort(part, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        octets, at = np.unique(rows >> 3, return_inverse=True)  # the bytes where the part has a row
        here = np.zeros(len(octets), np.uint8)
        np.bitwise_or.at(here, at, (128 >> (rows & 7)).astype(np.uint8))
        failing = [x[octets] & here for x in fails]
        quality, poison = good[octets], toxic[octets]
        fallen = {0: np.zeros_like(here)}
        for before in range(1, 32):
            low = (before & -before).bit_length() - 1
            fallen[before] = fallen[before & (before - 1)] | failing[low]
        for f in range(5):
            alone = _count(failing[f] & ~fallen[31 & ~(1 << f)])
            for before in (s for s in range(32) if not s >> f & 1):
                here_removed = failing[f] & ~fallen[before]
                yield int(part[rows[0]]), before, f, _count(here & ~fallen[before] & ~failing[f]), _count(here_removed), _count(failing[f] & fallen[before]), alone, _count(here_removed & quality), _count(here_removed & poison)


def subset_counts(rows: DataFrame) -> DataFrame:
    """(part, before, f, then COUNTS) summed over all blocks of the index."""
    names = ("part", "before", "f", *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("audit", None, dict)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                block = b.slice(at, BLOCK)
                parts = block.column(0).dictionary_encode()
                found = list(block_counts(parts.indices.to_numpy(zero_copy_only=False), block.column(1).to_numpy(zero_copy_only=False)))
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([parts.dictionary.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:])], names=list(names))

    kinds = "part string, " + ", ".join(f"{n} long" for n in names[1:])
    return rows.mapInArrow(run, kinds).groupBy("part", "before", "f").agg(*(F.sum(c).alias(c) for c in COUNTS))


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, f): the five steps of each of the 120 orders."""
    steps = []
    for order in permutations(range(5)):
        before = 0
        for k, f in enumerate(order, 1):
            steps.append(("".join(FILTERS[x] for x in order), k, before, f))
            before |= 1 << f
    return spark.createDataFrame(steps, "filter_order string, step int, before long, f long")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters, and step."""
    sums = saved(subset_counts(with_labels(with_repeats(saved(flags(docs))), labels)))  # 80 rows a part
    # a subset stands before its filter in as many orders as its members and the others can be arranged
    times = F.element_at(F.array(*(F.lit(factorial(k) * factorial(4 - k)) for k in range(5))), F.bit_count("before") + 1)
    shapley = sums.groupBy("part", "f").agg(F.sum(F.col("removed") * times).alias("shapley"))
    steps = F.broadcast(orders(docs.sparkSession))  # 600 rows
    return sums.join(shapley, ["part", "f"]).join(steps, ["before", "f"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with known as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
),
texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents
),
rows as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(texts.doc_id > first, false)] as x
  from texts left join known using (doc_id)
),
kinds as (select part, good, toxic, x, count(*) as n from rows group by all),
letters as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps as (select o, list_reduce(list_transform(o, lambda i: substr('ABCDE', i, 1)), lambda p, q: p || q) as filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
judged as (
  select part, filter_order, step, o[step] as f, good, toxic, n, x[o[step]] as fails,
    list_bool_or(list_transform(o[1:step - 1], lambda i: x[i])) is true as gone,
    len(list_filter(x, lambda v: v)) = 1 as single
  from steps, kinds
),
counted as (
  select part, filter_order, step, f,
    coalesce(sum(n) filter (not gone and not fails), 0)::bigint as kept,
    coalesce(sum(n) filter (not gone and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and fails), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails and single), 0)::bigint as unique_fails,
    coalesce(sum(n) filter (not gone and fails and good = 1), 0)::bigint as good_lost,
    coalesce(sum(n) filter (not gone and fails and toxic = 1), 0)::bigint as toxic_lost
  from judged group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from counted
"""

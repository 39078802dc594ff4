"""Importance resampling towards a target distribution over hashed n-grams, with CRC combination algebra.

A word's crc32 is computed once, on its bytes. The crc32 of an n-gram follows from those of its words: putting a word of k bytes
behind a text multiplies the text's crc, a vector over GF(2), by the matrix that shifts it by k zero bytes, and adds the word's. The
matrices of the powers of two are kept as byte tables, so a shift takes one look-up round per binary digit of k. No n-gram is
ever built as a string, and a batch of documents is handled by array operations on its bytes.

Two passes read the texts. The first counts features by bucket (dense counts per task, summed by a shuffle of at most ``buckets``
rows a task); the counts of the buckets, a table of fixed size, give each bucket's gain. The second sums up gains by
document. Ranks come from one range sort of (score, doc_id): positions inside a range plus the rows of the ranges before.

Defined cases: a null text has no words, a document without features has weight 0. A null doc_id is drawn by ``7:`` and comes last among
ties; rows that repeat a doc_id are documents of their own, ranked one after the other. Extra columns are ignored by ``resample``.
An empty table gives an empty result; an empty target table gives gains from its zero counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, saved, small_batches, table

BUCKETS, MAX_WORDS, SEED = 10_000, 2, 7
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of a word that are taken step by step over all words together; longer words go to zlib one by one.
STEPS = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The crc32 table, and for each j the byte tables of the matrix that shifts by 2**j zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> 1) ^ (np.uint32(0xEDB88320) * (step & 1))
    byte = np.arange(256, dtype=np.uint32)
    values = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    shift = step[values & 255] ^ (values >> 8)
    powers = [shift]
    for _ in range(31):
        powers.append(_times(powers[-1], powers[-1]))
    return step, np.stack(powers)


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    return matrix[0][x & 255] ^ matrix[1][(x >> 8) & 255] ^ matrix[2][(x >> 16) & 255] ^ matrix[3][x >> 24]


CRC_STEP, SHIFT = _tables()
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each crc as it counts ``size`` bytes before the end of a longer text."""
    out = crc.copy()
    for j in range(int(size.max()).bit_length() if len(size) else 0):
        on = (size >> j & 1).astype(bool)
        out[on] = _times(SHIFT[j], out[on])
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(size <= STEPS)
    for k in range(STEPS):
        left = left[size[left] > k]
        if not len(left):
            break
        c = crc[left]
        crc[left] = CRC_STEP[(c ^ data[start[left] + k]) & 255] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > STEPS).tolist():
        crc[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes())
    return crc


_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words, after lower-casing: digits, letters and all bytes of characters beyond ASCII.
IN_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def features(texts: pa.Array, max_words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words and features of each text (UTF-8, binary), and by n-gram length their crcs and texts."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    first = inside[1:] & ~inside[:-1]
    end = inside[:-1] & ~inside[1:]  # place one after a word
    cut = at[(at > 0) & (at < len(data))]  # a new text begins within a run
    cut = cut[inside[cut] & inside[cut + 1]]
    first[cut] = end[cut] = True
    start = np.flatnonzero(first)
    size = np.flatnonzero(end) - start
    text = np.searchsorted(at, start, side="right") - 1
    crc = word_crcs(data, start, size)
    words = np.bincount(text, minlength=len(texts)).astype(np.int64)
    count, crcs, owners = words.copy(), [crc], [text]
    begins = np.arange(len(text))
    for n in range(2, max_words + 1):
        last = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
        # the n-grams that begin at these words: the (n-1)-gram there, a space, and the word n-1 places on
        before = crcs[-1][np.searchsorted(begins, last)]
        tail = last + n - 1
        crcs.append(shifted(_times(SHIFT[0], before) ^ SPACE, size[tail]) ^ crc[tail])
        owners.append(text[last])
        count += np.bincount(text[last], minlength=len(texts))
        begins = last
    return words, count, crcs, owners


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """(bucket, n): how often features of the column ``text`` fall in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("importance", None, dict)  # lets go of what other operators kept
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for crc in features(b.column(0), max_words)[2]:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Each bucket's gain in thousandths: how much likelier the target's features are there, counts smoothed by one."""
    spark = docs.sparkSession
    s, t = (bucket_counts(x, buckets, max_words).withColumnRenamed("n", c) for x, c in ((docs, "s"), (target, "t")))
    both = spark.range(buckets).toDF("bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    both = saved(both)  # one row a bucket
    every = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(every["s"] + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(every["t"] + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weighed(docs: DataFrame, gain: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each document's features."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("importance", None, dict)
        for b in batches:
            words, count, crcs, owners = features(b.column(1), max_words)
            total = np.zeros(b.num_rows, np.int64)
            for crc, owner in zip(crcs, owners):
                sums = np.concatenate(([0], np.cumsum(gain[crc % buckets])))
                ends = np.searchsorted(owner, np.arange(b.num_rows), side="right")
                total += np.diff(sums[ends], prepend=0)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy_score(seed: int = SEED) -> F.Column:
    """The weight plus Gumbel noise drawn from a hash of the seed and the doc_id: highest scores are a draw without replacement."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: F.Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in a global order: a range sort, then the rows of the ranges before are added."""
    place = F.col("_place")
    sorted_rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(place, 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    joined = sorted_rows.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return joined.withColumn(name, F.col("_before") + place.bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_words: int = MAX_WORDS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document's n_words, n_features, weight and score; ``rank`` numbers the drawn ones, the others have none.

    Of the N documents with at least ``least_words`` words floor(percent * N / 100) are drawn, by score.
    """
    scored = weighed(docs, gains(docs, target, buckets, max_words), max_words).withColumn("score", noisy_score(seed))
    # equal rows are told apart by where they were read, so that no range of the sort holds them all
    scored = saved(scored.withColumn("_row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    quota = percent * scored.where(enough).count() // 100
    place = ranked(scored, enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc())
    return place.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).drop("_row")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is affine over GF(2): a feature's is the exclusive or of what each byte contributes at its distance from the end.
OP13_SQL = r"""
with recursive
step as (
  select b, list_reduce(range(0, 9), lambda x, i: case when i = 0 then x else xor(x >> 1, 3988292384 * (x & 1)) end, b::bigint) as c from range(256) t(b)
),
words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
),
found as (
  select kind, id, unnest(w) as f from words
  union all
  select kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
),
counted as (select kind, id, f, count(*) as n from found group by all),
feats as (select distinct f from counted),
longest as (select max(octet_length(encode(f))) as m from feats),
shifts(d, b, c) as (
  select 0, b, c from step
  union all
  select d + 1, s.b, xor(t.c, s.c >> 8) from shifts s join step t on t.b = (s.c & 255) where d + 1 < (select m from longest)
),
inits(n, c) as (
  select 0, 4294967295::bigint
  union all
  select n + 1, xor(t.c, i.c >> 8) from inits i join step t on t.b = (i.c & 255) where n < (select m from longest)
),
octets as (
  select f, octet_length(encode(f)) as n, unnest(range(0, octet_length(encode(f)))) as i, hex(encode(f)) as h from feats
),
crcs as (
  select f, xor(xor(bit_xor(s.c), any_value(i.c)), 4294967295) % 10000 as bucket
  from octets o join shifts s on s.d = o.n - 1 - o.i and s.b = ('0x' || substr(o.h, 2 * o.i + 1, 2))::int join inits i on i.n = o.n
  group by f
),
buckets as (
  select r.bucket, coalesce(sum(n) filter (kind = 'd'), 0)::bigint as s, coalesce(sum(n) filter (kind = 'b'), 0)::bigint as t
  from range(10000) r(bucket) left join (select * from counted join crcs using (f)) c on c.bucket = r.bucket group by r.bucket
),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double)))::bigint as g from buckets
),
weights as (
  select id, sum(n)::bigint as n_features, sum(n * g)::bigint as total from counted join crcs using (f) join gain using (bucket) where kind = 'd' group by id
),
scored as (
  select d.doc_id, coalesce(n_features, 0)::bigint as n_features, len(w) as n_words, coalesce(floor_div, 0)::bigint as weight,
    coalesce(floor_div, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents d join (select id, w from words where kind = 'd') x on x.id = d.doc_id
  left join (select id, n_features, (total - ((total % n_features) + n_features) % n_features) // n_features as floor_div from weights) y on y.id = d.doc_id
)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= (25 * (select count(*) from scored where n_words >= 20)) // 100 then r end::bigint as rank
from (select *, row_number() over (order by n_words >= 20 desc, score desc, doc_id) as r from scored)
"""

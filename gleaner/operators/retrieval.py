"""Candidate channels over a shared posting table, many queries at once.

Postings are one row a (document, term): they are built once and reused by every channel. A query set is a
small table (query_id, term, weight); it meets the postings in an equi join on the term, so a channel is two
shuffles at most and no pair of query and document is formed that shares no term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemmer import STOP_WORDS, stemmed
from ..functions.text import aliases, cjk_grams, terms
from ..sources.tables import saved
from .access import active_members, may_read
from .matching import CHANNELS, matched
from .positions import holders
from .ranking import fused, ranked, rolled_up


def postings(docs: DataFrame, text: str = "content", id: str = "id", wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf) of each document; with ``wanted`` only of its terms, so that no other posting is moved."""
    each = docs.select(F.col(id).alias("id"), F.explode(terms(F.col(text))).alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").distinct(), "term", "left_semi")
    return each.groupBy("id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, text: str = "text", id: str = "query_id", most: int = 32) -> DataFrame:
    """(query_id, term, weight, leading, n_terms): the distinct terms of each query; ``leading`` are the first ``most``.

    Weights: 4 capitalised, 3 with a digit, 1.5 from ten characters on, else 1; of repeated terms the first counts.
    """
    raw = F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_'-]*)"), 1)
    each = queries.select(F.col(id).alias("query_id"), F.posexplode(raw).alias("at", "word"))
    first = each.groupBy("query_id", F.lower("word").alias("term")).agg(F.min_by("word", "at").alias("word"), F.min("at").alias("at"))
    placed = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    w = F.col("word")
    weight = F.when(w.rlike(r"^\p{Lu}"), 4.0).when(w.rlike(r"\p{N}"), 3.0).when(F.length(w) >= 10, 1.5).otherwise(1.0)
    return placed.select("query_id", "term", weight.alias("weight"), (F.col("k") <= most).alias("leading"), F.count("*").over(Window.partitionBy("query_id")).alias("n_terms"))


def asked_words(queries: DataFrame, forms: set[str]) -> DataFrame:
    """The query set as ``matched`` takes it: the distinct terms of each query with their weights, and the stems of all but stop words."""
    parts = []
    if "term" in forms:
        parts.append(query_terms(queries).select("query_id", F.col("term").alias("word"), F.lit("term").alias("form"), "weight", "leading"))
    if "stem" in forms:
        each = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
        parts.append(stemmed(each).select("query_id", F.col("stem").alias("word"), F.lit("stem").alias("form"), F.lit(1.0).alias("weight"), F.lit(True).alias("leading")).distinct())
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.join(queries.select("query_id", "user_id"), "query_id") if "user_id" in queries.columns else every


def hits(docs: DataFrame, queries: DataFrame, channels: tuple[str, ...], limit: int | None = None, text: str = "content", ties: list[Column] | None = None) -> DataFrame:
    """(query_id, channel, id, score) of the lexical channels; see ``matched`` for the limit, which is a task's."""
    return matched(docs, asked_words(queries, {CHANNELS[c][0] for c in channels}), channels, limit, text=text, ties=ties)


def best_relaxed(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): the relaxed channel's first ``limit`` of each query."""
    found = hits(docs, queries, ("relaxed",), limit).select("query_id", "id", "score")
    return ranked(found, F.desc(F.round("score", 9)), F.col("id"), limit=limit)


def lexical(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, n, n_terms, plain, n_leading, weighted): what the strict and the relaxed channel need, in one pass.

    ``plain`` sums tf / (tf + 1) over all of the query's terms, ``weighted`` weight * tf / (tf + 1) over its leading ones.
    """
    part = F.col("tf") / (F.col("tf") + 1)
    return posted.join(wanted, "term").groupBy("query_id", "id").agg(
        F.count("*").alias("n"), F.max("n_terms").alias("n_terms"), F.sum(part).alias("plain"),
        F.count_if("leading").alias("n_leading"), F.sum(F.when(F.col("leading"), F.col("weight") * part)).alias("weighted"),
    )


def strict(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, score): documents that hold every term; score = sum of tf / (tf + 1)."""
    return lexical(posted, wanted).where("n = n_terms").select("query_id", "id", F.col("plain").alias("score"))


def relaxed(posted: DataFrame, wanted: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, id, score, n): documents with at least ``least`` leading terms; score = sum of weight * tf / (tf + 1)."""
    hit = lexical(posted, wanted).where(F.col("n_leading") >= least)
    return hit.select("query_id", "id", F.col("weighted").alias("score"), F.col("n_leading").alias("n"))


def english(docs: DataFrame, queries: DataFrame, text: str = "content") -> DataFrame:
    """(query_id, id, score): documents that hold the stem of every query term but stop words; score = sum of tf / (tf + 1).

    Words are stemmed where the documents are read; only hits are moved.
    """
    return hits(docs, queries, ("stems",), text=text).select("query_id", "id", "score")


def phrase(docs: DataFrame, queries: DataFrame, text: str = "content", block: int = 5000) -> DataFrame:
    """(query_id, id): documents whose text holds the query's text, upper and lower case alike.

    The query set meets all documents in blocks of about ``block`` texts: each document is read once a block, by one automaton over the block's
    texts, and only hits are moved.
    """
    return holders(docs.select("id", F.lower(text).alias("normal")), queries.select("query_id", F.lower("text").alias("needle")), block)


def alias_hits(docs: DataFrame, queries: DataFrame, text: str = "content", most: int = 8) -> DataFrame:
    """(query_id, id, hits, longest): documents that share aliases with the query."""
    have = docs.select("id", F.explode(aliases(F.col(text))).alias("alias"))
    want = queries.select("query_id", F.explode(F.slice(aliases(F.col("text")), 1, most)).alias("alias"))
    return have.join(want, "alias").groupBy("query_id", "id").agg(F.count("*").alias("hits"), F.max(F.length("alias")).alias("longest"))


def gram_hits(docs: DataFrame, grams: DataFrame, text: str = "content", size: int = 3) -> DataFrame:
    """(query_id, id, total, hits): documents that hold at least min(2, all) of the query's CJK grams.

    Documents are cut into grams of both sizes, so the join is on equality.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー々ゝゞヽヾ]+)"), 1)
    cut = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - n + 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    want = grams.select("query_id", F.explode("grams").alias("gram"), F.size("grams").alias("n"))
    # only grams of the query set are moved
    have = docs.select("id", F.explode(F.array_distinct(F.concat(cut(2), cut(size)))).alias("gram")).join(want.select("gram").distinct(), "gram", "left_semi")
    hit = have.join(want, "gram").groupBy("query_id", "id").agg(F.count("*").alias("hits"), F.sum(F.length("gram")).alias("total"), F.max("n").alias("n"))
    return hit.where(F.col("hits") >= F.least(F.lit(2), F.col("n"))).select("query_id", "id", "total", "hits")


def _tiles(vectors: DataFrame, key: str, rows: int) -> DataFrame:
    """Vectors as tiles of one length: (keys, dims, flat, norms), in doubles; no shuffle."""
    kind = vectors.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vs):
                if v and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for dims, at in by_size.items():
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    x = np.array([vs[i] for i in some], np.float64)
                    keys = b.column(0).take(pa.array(some))
                    whole = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), keys)
                    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
                    yield pa.RecordBatch.from_arrays([whole, pa.array([dims]), pa.array([x.tobytes()], pa.binary()), pa.array([norms.tobytes()], pa.binary())], names=["keys", "dims", "flat", "norms"])

    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("dims", T.LongType()), T.StructField("flat", T.BinaryType()), T.StructField("norms", T.BinaryType())])
    return vectors.select(key, "embedding").mapInArrow(run, schema)


def semantic(vectors: DataFrame, queries: DataFrame, threshold: float, tile_rows: int = 1024, block: int = 8) -> DataFrame:
    """(query_id, id, distance): vectors within a cosine distance of each query vector.

    ``queries`` is a stated query set that meets all vectors in blocks: both sides are gathered into tiles, and each
    pair of tiles is one matrix product. Vectors stay where they were read; the queries are broadcast to them, at most
    ``block`` tiles of ``tile_rows`` vectors at a time. Zero vectors and those with nulls are near nothing.
    """
    left = _tiles(vectors.withColumnRenamed("vec_id", "id"), "id", tile_rows)
    tiles = max(1, -(-queries.count() // tile_rows))
    dealt = _tiles(queries.repartition(tiles), "query_id", tile_rows).withColumn("_block", F.floor(F.spark_partition_id() / block))
    right = saved(dealt).select("_block", *(F.col(c).alias(f"q_{c}") for c in ("keys", "dims", "flat", "norms")))
    pairs = None
    for k in range(-(-tiles // block)):
        met = left.join(F.broadcast(right.where(F.col("_block") == k).drop("_block")), F.col("dims") == F.col("q_dims"))
        pairs = met if pairs is None else pairs.unionByName(met)
    schema = T.StructType([T.StructField("query_id", right.schema["q_keys"].dataType.elementType), T.StructField("id", left.schema["keys"].dataType.elementType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            for k in range(b.num_rows):
                dims = col["dims"][k].as_py()
                x, y = (np.frombuffer(col[c][k].as_py(), np.float64).reshape(-1, dims) for c in ("flat", "q_flat"))
                nx, ny = (np.frombuffer(col[c][k].as_py(), np.float64) for c in ("norms", "q_norms"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1 - (x @ y.T) / (nx[:, None] * ny[None, :])
                i, j = np.nonzero(d <= threshold)
                yield pa.RecordBatch.from_arrays([col["q_keys"][k].values.take(pa.array(j)), col["keys"][k].values.take(pa.array(i)), pa.array(d[i, j])], names=["query_id", "id", "distance"])

    return pairs.mapInArrow(run, schema)


def bm25(docs: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of documents (id) that share a token; repeated query tokens count each time."""
    want = queries.select("query_id", F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # only the query set's terms are counted and moved
    each = docs.select("id", F.explode(tokens).alias("term")).join(want.select("term").distinct(), "term", "left_semi")
    tf = each.groupBy("id", "term").agg(F.count("*").alias("tf"))
    lengths = docs.select("id", F.size(tokens).alias("length"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hit = tf.join(want, "term").join(df, "term").join(lengths, "id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.groupBy("query_id", "id").agg(F.sum(F.col("times") * part).alias("score"))


def evidence(chunks: DataFrame, anchors: DataFrame, neighbors: int = 1, by: str = "query_id") -> DataFrame:
    """(query_id, id, evidence, n_chunks): the anchors' chunks (query_id, id, ordinal) with their neighbours, in order.

    Windows are exploded to ordinals, so the join is on equality and overlapping windows count once.
    """
    want = anchors.select(by, "id", F.explode(F.sequence(F.col("ordinal") - neighbors, F.col("ordinal") + neighbors)).alias("ordinal")).distinct()
    got = chunks.join(F.broadcast(want), ["id", "ordinal"])  # a few anchors a query of a stated set
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    return got.groupBy(by, "id").agg(F.concat_ws("", F.transform(parts, lambda p: p["chunk"])).alias("evidence"), F.count("*").alias("n_chunks"))


def memory_search(pieces: DataFrame, queries: DataFrame, memberships: DataFrame, vectors: DataFrame, wanted: DataFrame, limit: int, threshold: float = 0.5, with_aliases: bool = False, with_english: bool = True) -> DataFrame:
    """(query_id, id, rank, score): memories by their best chunk's fused score over all channels.

    ``pieces`` are chunks (id, ordinal, chunk) with their memory's workspace_id, owner_id, scope and updated_at, ``queries``
    (query_id, user_id, text) and ``wanted`` (query_id, embedding) a stated set; ``vectors`` has the columns of
    ``pieces`` with embedding. Hits that the query's user may not read go before any rank is given.

    Of the chunks only hits move, of the lexical channels those that a ranking may hold. The simple and the English channel rank by the density of the
    windows that cover the query.
    """
    cut = min(4 * limit, 800)
    key = F.struct(F.col("id").alias("memory_id"), "ordinal", "workspace_id", "owner_id", "scope", "updated_at")
    members = active_members(memberships).join(queries.select("user_id").distinct(), "user_id", "left_semi")
    of = members.groupBy("workspace_id").agg(F.collect_set("user_id").alias("_members"))  # the asking users only
    chunks = pieces.join(F.broadcast(of), "workspace_id").select(key.alias("id"), F.col("chunk").alias("content"), F.filter("_members", lambda u: may_read(u)).alias("readers"))
    hit = lambda name, first, second=F.lit(0.0): F.struct(name.alias("channel"), F.round(first.cast("double"), 9).alias("first"), second.cast("double").alias("second"))
    latest = [-F.unix_micros(F.col("id.updated_at").cast("timestamp")), -F.col("id.ordinal"), F.col("id.memory_id")]
    lexical_hits = hits(chunks, queries, ("simple", "relaxed", *(["english"] if with_english else [])), cut, ties=latest)
    near = semantic(vectors.select(key.alias("vec_id"), "embedding"), wanted, threshold)
    found = [lexical_hits.select("query_id", "id", hit(F.col("channel"), F.col("score")).alias("hit")), near.select("query_id", "id", hit(F.lit("semantic"), -F.col("distance")).alias("hit"))]
    asked_grams = queries.select("query_id", cjk_grams(F.col("text")).alias("grams")).where(F.size("grams") > 0)
    if not asked_grams.isEmpty():
        found.append(gram_hits(chunks, asked_grams).select("query_id", "id", hit(F.lit("cjk"), F.col("total"), F.col("hits")).alias("hit")))
    if with_aliases:
        found.append(alias_hits(chunks, queries).select("query_id", "id", hit(F.lit("alias"), F.col("hits"), F.col("longest")).alias("hit")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    asks = queries.select("query_id", "user_id").join(active_members(memberships), "user_id")
    seen = every.select("query_id", "id", "hit.*", "id.workspace_id", "id.owner_id", "id.scope").join(asks, ["query_id", "workspace_id"]).where(may_read(F.col("user_id")))
    order = (F.desc("first"), F.desc("second"), F.desc("id.updated_at"), F.desc("id.ordinal"), F.col("id.memory_id"))
    best = fused([ranked(seen, *order, by=["query_id", "channel"], limit=cut)])
    memory = F.struct("id.memory_id", "id.updated_at")
    top = ranked(rolled_up(best.withColumn("memory", memory), "memory"), F.desc(F.round("score", 9)), F.desc("memory.updated_at"), F.col("memory.memory_id"), limit=limit)
    return top.select("query_id", F.col("memory.memory_id").alias("id"), "rank", "score")

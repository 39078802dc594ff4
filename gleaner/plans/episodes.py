"""Queries of episodes and answers: alias channel, evidence rules, facts, frames, hops, documents in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.unicode import normalized
from ..operators import answers as A
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources.tables import table
from .registry import query
from .retrieval import _ALIAS, _EPI, _RELAXED, _STOPS, _TERMS, _memories, _queries, _rank


def _alias(name: str, id: str, source: str, most: int) -> str:
    found = _ALIAS.format(id=id, t="text", f=source).replace("a0 AS", f"{name}0 AS")
    kept = f"SELECT DISTINCT id, alias, len(regexp_split_to_array(alias, '\\s+')) AS words FROM {name}0 WHERE length(alias) BETWEEN 2 AND 128 AND regexp_matches(alias, '\\p{{L}}') AND alias NOT IN ({_STOPS})"
    return f"{found}, {name} AS (SELECT id, alias FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY words DESC, length(alias) DESC, alias) AS k FROM ({kept})) WHERE k <= {most})"


@query("alias_channel", f"""WITH {_alias('d', 'doc_id', 'documents', 64)}, {_alias('b', 'item_id', 'benchmark', 8)} SELECT b.id AS query_id, d.id AS id, count(*) AS hits, max(length(alias)) AS longest FROM d JOIN b USING (alias) GROUP BY 1, 2""")
def alias_channel(spark: SparkSession, d: str) -> DataFrame:
    hits = S.alias_hits(_memories(spark, d), _queries(spark, d))
    return hits.select("query_id", "id", "hits", F.col("longest").cast("long").alias("longest"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ordinal"), F.col("text").alias("chunk"))


def _anchors(spark: SparkSession, d: str, limit: int) -> DataFrame:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    hits = S.best_relaxed(turns, _queries(spark, d), limit)
    return hits.select("query_id", F.floor(F.col("id") / 1000).alias("id"), (F.col("id") % 1000).alias("ordinal"), "rank")


_FOUND = f"{_EPI}, {_TERMS}, {_RELAXED}, h AS (SELECT query_id, id // 1000 AS id, id % 1000 AS ordinal, rank FROM (SELECT *, {_rank()} AS rank FROM r) WHERE rank <= 30)"


@query("answer_evidence", f"""WITH {_FOUND}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank) AS k FROM h) WHERE k <= 1), n AS (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1), a AS (SELECT k.*, n <= 3 AS whole FROM k JOIN n USING (id)),
c AS (SELECT conv_id AS id, turn AS ordinal, text AS chunk FROM conversations), w AS (SELECT DISTINCT a.query_id, c.id, c.ordinal, c.chunk, a.whole FROM a JOIN c ON c.id = a.id AND (a.whole OR abs(c.ordinal - a.ordinal) <= 1)) SELECT query_id, id, md5(string_agg(chunk, '' ORDER BY ordinal)) AS digest, count(*) AS n_chunks, whole FROM w GROUP BY query_id, id, whole""")
def answer_evidence(spark: SparkSession, d: str) -> DataFrame:
    got = A.answer_evidence(_turns(spark, d), _anchors(spark, d, 30), 1, 1)
    return got.select("query_id", "id", F.md5(F.col("evidence").cast("binary")).alias("digest"), "n_chunks", "whole")


@query("rerank_evidence", f"""WITH {_FOUND}, b AS (SELECT query_id, id, arg_min(ordinal, rank) AS ordinal FROM h GROUP BY 1, 2) SELECT b.query_id, b.id, md5(string_agg(c.text, '' ORDER BY c.turn)) AS digest, count(*) AS n_chunks FROM b JOIN conversations c ON c.conv_id = b.id AND abs(c.turn - b.ordinal) <= 1 GROUP BY 1, 2""")
def rerank_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What a reranker reads: each memory's best chunk and its neighbours only."""
    best = _anchors(spark, d, 30).groupBy("query_id", "id").agg(F.min_by("ordinal", "rank").alias("ordinal"))
    return S.evidence(_turns(spark, d), best).select("query_id", "id", F.md5(F.col("evidence").cast("binary")).alias("digest"), "n_chunks")


@query("episode_rerank", f"""WITH {_FOUND}, e0 AS (SELECT query_id, id, min(rank) AS best FROM h GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, id) AS rank, (id % 89) / 89.0 AS rerank_score FROM e0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS rerank_rank FROM e)
SELECT query_id, id, round(0.75 / (60 + rerank_rank) + 0.25 / (60 + rank), 6) AS score FROM k WHERE rerank_score >= 0.2""")
def episode_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Episodes by a weighted fusion of both ranks; those under the least score go after ranks are given."""
    e = R.ranked(_anchors(spark, d, 30).groupBy("query_id", "id").agg(F.min("rank").alias("best")), F.col("best"), F.col("id"))
    scored = e.withColumn("rerank_score", (F.col("id") % 89) / 89.0)
    return R.rerank_fused(scored, 0.75).where("rerank_score >= 0.2").select("query_id", "id", F.round("score", 6).alias("score"))


@query("numbered_facts", r"""WITH t AS (SELECT conv_id, string_agg((turn // 2) || '. ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1), l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
f AS (SELECT conv_id, pos, CAST(regexp_extract(line, '^\s*(\d+)\.\s+(.+?)\s*$', 1) AS BIGINT) AS serial, regexp_extract(line, '^\s*(\d+)\.\s+(.+?)\s*$', 2) AS fact FROM l WHERE regexp_matches(line, '^\s*(\d+)\.\s+(.+?)\s*$')) SELECT conv_id, serial, md5(arg_min(fact, pos)) AS digest FROM f GROUP BY 1, 2""")
def numbered_facts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as numbered lines, two turns to a number."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.floor(F.col("turn") / 2).cast("string"), F.lit(". "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))))
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("text"))
    return A.numbered_facts(texts, "conv_id").select("conv_id", "serial", F.md5(F.col("fact").cast("binary")).alias("digest"))


@query("framed_answers", """WITH f AS (SELECT p_partkey AS serial, p_brand || ' holds ' || p_name || ' of size ' || p_size AS fact FROM part), r AS (SELECT row_number() OVER (ORDER BY p_brand, p_size) AS frame_id, p_brand || ' holds ' AS prefix, ' of size ' || p_size AS suffix FROM (SELECT DISTINCT p_brand, p_size FROM part))
SELECT frame_id, arg_max(substr(fact, length(prefix) + 1, length(fact) - length(prefix) - length(suffix)), serial) AS answer, max(serial) AS serial, count(*) AS n FROM f JOIN r ON starts_with(fact, prefix) AND ends_with(fact, suffix) GROUP BY 1""")
def framed_answers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    facts = p.select(F.col("p_partkey").alias("serial"), F.concat("p_brand", F.lit(" holds "), "p_name", F.lit(" of size "), F.col("p_size").cast("string")).alias("fact"))
    frames = R.placed(p.select("p_brand", "p_size").distinct(), F.col("p_brand"), F.col("p_size"), name="frame_id")
    frames = frames.select("frame_id", F.concat("p_brand", F.lit(" holds ")).alias("prefix"), F.concat(F.lit(" of size "), F.col("p_size").cast("string")).alias("suffix"))
    return A.framed_answers(facts, frames)


@query("multi_hop", """WITH s AS (SELECT l_partkey AS part, arg_max(l_suppkey, l_orderkey * 1000 + l_linenumber) AS supplier FROM lineitem GROUP BY 1) SELECT p_partkey AS question_id, CASE WHEN p_partkey % 3 = 0 THEN 'supplier ' || s.supplier WHEN p_partkey % 3 = 1 THEN 'nation ' || n_name ELSE 'region ' || r_name END AS answer, 1 + p_partkey % 3 AS n_hops
FROM part JOIN s ON s.part = p_partkey LEFT JOIN supplier ON s_suppkey = s.supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND n_name IS NOT NULL) OR r_name IS NOT NULL""")
def multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """From a part to its last supplier, that one's nation and its region, as far as the question goes."""
    li, s, n, r, p = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region", "part"))
    named = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    fact = lambda df, subject, relation, answer, serial: df.select(subject.alias("subject"), F.lit(relation).alias("relation"), answer.alias("answer"), serial.cast("long").alias("serial"))
    facts = fact(li, named("part", "l_partkey"), "supplier", named("supplier", "l_suppkey"), F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    facts = facts.unionByName(fact(s.join(n, s.s_nationkey == n.n_nationkey), named("supplier", "s_suppkey"), "nation", named("nation", "n_name"), F.lit(1)))
    facts = facts.unionByName(fact(n.join(r, n.n_regionkey == r.r_regionkey), named("nation", "n_name"), "region", named("region", "r_name"), F.lit(1)))
    relations = F.slice(F.array(*map(F.lit, ("supplier", "nation", "region"))), F.lit(1), (1 + F.col("p_partkey") % 3).cast("int"))
    return A.hops(p.select(F.col("p_partkey").alias("question_id"), named("part", "p_partkey").alias("subject"), relations.alias("relations")), facts)


_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({0}, ',', '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the|and)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("substring_matches", f"""WITH a AS (SELECT item_id, {_BARE.format("substr(text, 1, 60)")} AS answer FROM benchmark), d AS (SELECT doc_id, {_BARE.format("text")} AS text FROM documents) SELECT item_id, doc_id FROM a JOIN d ON length(answer) >= 3 AND contains(d.text, answer)""")
def substring_matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the start of a passage, both normalised as answers are."""
    answers = _queries(spark, d).select("query_id", X.normalized_answer(F.substring("text", 1, 60)).alias("text")).where(F.length("text") >= 3)
    docs = _memories(spark, d).select("id", X.normalized_answer(F.col("content")).alias("content"))
    return S.phrase(docs, answers).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("connected_links", """SELECT o_custkey AS source_id, o_orderkey AS target_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE 'related' END AS kind, round(greatest(0.0, least(1.0, o_totalprice / 100000 - 0.1)), 7) AS weight FROM orders WHERE o_custkey <> o_orderkey""")
def connected_links(spark: SparkSession, d: str) -> DataFrame:
    """New links: weights are clamped to [0, 1], a kind that is missing is ``related``, none leads to itself."""
    from ..operators.access import connected

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("kind"), (F.col("o_totalprice") / 100000 - 0.1).alias("weight"))
    return connected(o).withColumn("weight", F.round("weight", 7))


@query("this_variants", """SELECT p_partkey, unnest(list_distinct([symbol, member, parent || '.' || member])) AS candidate FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'this.' ELSE '' END || lower(split_part(p_name, ' ', 1)) AS symbol, lower(split_part(p_name, ' ', 1)) AS member, p_brand AS parent FROM part) WHERE starts_with(symbol, 'this.') UNION ALL SELECT p_partkey, lower(split_part(p_name, ' ', 1)) FROM part WHERE p_size % 2 <> 0""")
def this_variants(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.code_graph import this_candidates

    name = F.lower(F.split("p_name", " ")[0])
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "this.").otherwise(""), name).alias("symbol"), F.col("p_brand").alias("parent"))
    return p.select("p_partkey", F.explode(this_candidates(F.col("symbol"), F.col("parent"))).alias("candidate"))


@query("marked_documents", r"""WITH t AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'Document ' || turn || ': ' ELSE '' END || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1), p AS (SELECT conv_id, unnest(list_filter(string_split(regexp_replace(text, '(Document \d+:)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '')) AS part, generate_subscripts(list_filter(string_split(regexp_replace(text, '(Document \d+:)', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> ''), 1) - 1 AS ordinal FROM t) SELECT conv_id, ordinal, md5(part) AS digest FROM p""")
def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold documents behind markers, cut before each marker."""
    from ..functions.text import documents_in

    line = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Document "), F.col("turn").cast("string"), F.lit(": "))).otherwise(""), "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("text"))
    return texts.select("conv_id", F.posexplode(documents_in(F.col("text"))).alias("ordinal", "part")).select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5(F.col("part").cast("binary")).alias("digest"))


@query("unicode_nfc", """SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)))) AS digest FROM documents""")
def unicode_nfc(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose accents were taken apart, put together again."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    return normalized(table(spark, d, "documents").select("doc_id", apart.alias("text")), "text", "NFC").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("cursor_pages", """WITH k AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT k AS after, to_base64(encode(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey)) AS cursor, CASE WHEN k < n THEN k + 1 END AS next, o_orderdate AS decoded_date, o_orderkey AS decoded_key FROM k WHERE k % 500 = 0""")
def cursor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Keyset cursors: the sort key of every page's last row, encoded, where the page after it begins, and the key decoded again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = R.placed(o, F.desc("o_orderdate"), F.col("o_orderkey"), name="k")
    n = o.agg(F.count("*").alias("n"))  # one row
    cursor = F.base64(F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")).cast("binary"))
    pages = k.where("k % 500 = 0").crossJoin(F.broadcast(n)).select(F.col("k").alias("after"), cursor.alias("cursor"), F.when(F.col("k") < F.col("n"), F.col("k") + 1).alias("next"))
    key = F.split(F.unbase64("cursor").cast("string"), r"\|")
    return pages.withColumn("decoded_date", key[0].cast("timestamp_ntz")).withColumn("decoded_key", key[1].cast("long"))

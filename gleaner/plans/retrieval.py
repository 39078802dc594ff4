"""Retrieval queries: chunking, channels, fusion, evidence and their evaluation, over whole query sets.

Queries are the benchmark passages, memories are the documents; every ranking ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chunking import chunked
from ..functions.stemmer import STOP_WORDS, stem_sql, stemmed
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources import views as V
from ..sources.tables import balanced, saved, table
from .registry import query

LIMIT = 20


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return balanced(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


_POST = r"""p AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}][\p{L}\p{N}_''-]*)', 1)) AS term FROM documents) GROUP BY 1, 2)"""
_TERMS = r"""w0 AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '([\p{L}\p{N}][\p{L}\p{N}_''-]*)', 1)) AS word, generate_subscripts(regexp_extract_all(text, '([\p{L}\p{N}][\p{L}\p{N}_''-]*)', 1), 1) AS pos FROM benchmark)),
w1 AS (SELECT query_id, lower(word) AS term, arg_min(word, pos) AS word, min(pos) AS pos FROM w0 GROUP BY 1, 2), w2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM w1),
q AS (SELECT query_id, term, CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 4.0 WHEN regexp_matches(word, '\p{N}') THEN 3.0 WHEN length(word) >= 10 THEN 1.5 ELSE 1.0 END AS weight, k, count(*) OVER (PARTITION BY query_id) AS n_terms FROM w2)"""
_STRICT = "s AS (SELECT query_id, id, sum(tf / (tf + 1)) AS score FROM p JOIN q USING (term) GROUP BY 1, 2 HAVING count(*) = max(n_terms))"
_RELAXED = "r AS (SELECT query_id, id, sum(weight * tf / (tf + 1)) AS score, count(*) AS n FROM p JOIN q USING (term) WHERE k <= 32 GROUP BY 1, 2 HAVING count(*) >= 2)"
_WITH = f"WITH {_POST}, {_TERMS}"


def _rank(score: str = "score", by: str = "query_id", down: bool = True) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) {'DESC' if down else ''}, id)"


def relaxed_hits(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return S.best_relaxed(_memories(spark, d), _queries(spark, d), limit)


@query("chunk_reconstruct", """SELECT doc_id, md5(text) AS digest, true AS bounded FROM documents WHERE text <> ''""")
def chunk_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    c = chunked(balanced(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    return c.groupBy("doc_id").agg(F.md5(F.concat_ws("", F.transform(parts, lambda p: p["chunk"])).cast("binary")).alias("digest"), (F.max(F.length("chunk")) <= 1200).alias("bounded"))


@query("chunk_listing")
def chunk_listing(spark: SparkSession, d: str) -> DataFrame:
    return chunked(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "ordinal", F.length("chunk").alias("chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("lexical_strict", f"{_WITH}, {_STRICT} SELECT query_id, id, round(score, 6) AS score FROM s")
def lexical_strict(spark: SparkSession, d: str) -> DataFrame:
    return S.hits(_memories(spark, d), _queries(spark, d), ("strict",)).select("query_id", "id", F.round("score", 6).alias("score"))


@query("lexical_relaxed", f"{_WITH}, {_RELAXED} SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, {_rank()} AS rank FROM r) WHERE rank <= 20")
def lexical_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return relaxed_hits(spark, d, LIMIT).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_ENGLISH_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("stemmed_vocabulary", rf"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''-]*)', 1)) AS term FROM documents WHERE lang = 'en'), p AS (SELECT unnest(['relational', 'conditional', 'hopping', 'falling', 'filing', 'happy', 'sized', 'generalizations', 'oscillators', 'yes', 'agreed', 'replacement', 'adoption', 'controll']) AS term), w AS (SELECT * FROM v UNION SELECT * FROM p)
SELECT term, stem FROM ({stem_sql("w")})""")
def stemmed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The stems of all English documents' words, and of some words that the tables lack."""
    v = table(spark, d, "documents").where("lang = 'en'").select(F.explode(X.terms(F.col("text"))).alias("term"))
    more = "relational conditional hopping falling filing happy sized generalizations oscillators yes agreed replacement adoption controll"
    return stemmed(v.union(spark.createDataFrame([(w,) for w in more.split()], "term string")).distinct())


@query("english_channel", rf"""WITH {_POST}, v AS (SELECT DISTINCT term FROM p WHERE term NOT IN ({_ENGLISH_STOPS})), vs AS ({stem_sql("v")}), b AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''-]*)', 1)) AS term FROM benchmark), b1 AS (SELECT * FROM b WHERE term NOT IN ({_ENGLISH_STOPS})),
a AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, stem FROM ({stem_sql("b1")}))), t AS (SELECT id, stem, sum(tf) AS tf FROM p JOIN vs USING (term) GROUP BY 1, 2)
SELECT query_id, id, round(sum(tf / (tf + 1)), 6) AS score FROM t JOIN a USING (stem) GROUP BY 1, 2 HAVING count(*) = max(n_terms)""")
def english_channel(spark: SparkSession, d: str) -> DataFrame:
    return S.english(_memories(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 6))


@query("phrase_matches", "SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    docs, qs = _memories(spark, d), _queries(spark, d)
    return S.phrase(docs, qs)


_ALIAS = r"""a0 AS (SELECT {id} AS id, regexp_replace(regexp_replace(lower(trim(regexp_replace(a, '\s+', ' ', 'g'))), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '') AS alias FROM (SELECT {id}, unnest(list_concat(regexp_extract_all({t}, '"([^"\x00-\x1f\x7f]{{2,128}})"', 1),
regexp_extract_all({t}, '(\p{{Lu}}[\p{{L}}\p{{N}}_.''’:-]*(?:\s+(?:(?:of|the|and|for|de|da|del|van|von|la|le)\s+)?\p{{Lu}}[\p{{L}}\p{{N}}_.''’:-]*)*)', 1), regexp_extract_all({t}, '(\p{{Lu}}[\p{{L}}\p{{N}}_.''’:-]+)', 1), regexp_extract_all({t}, '([\p{{L}}\p{{N}}_./:#-]*\p{{N}}[\p{{L}}\p{{N}}_./:#-]*)', 1))) AS a FROM {f}))"""
_STOPS = ", ".join(f"'{w}'" for w in X.ALIAS_STOPS)


@query("alias_extract", f"""WITH {_ALIAS.format(id='conv_id, turn', t='text', f='conversations').replace('conv_id, turn AS id', 'conv_id, turn')}, b AS (SELECT DISTINCT conv_id, turn, alias, len(regexp_split_to_array(alias, '\\s+')) AS words FROM a0 WHERE length(alias) BETWEEN 2 AND 128 AND regexp_matches(alias, '\\p{{L}}') AND alias NOT IN ({_STOPS})),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY words DESC, length(alias) DESC, alias) AS k FROM b) SELECT conv_id, turn, string_agg(alias, '|' ORDER BY k) AS aliases FROM k WHERE k <= 64 GROUP BY 1, 2""")
def alias_extract(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", X.aliases(F.col("text")).alias("a"))
    return c.where(F.size("a") > 0).select("conv_id", "turn", F.concat_ws("|", "a").alias("aliases"))


_LETTERS, _HAN = "abcdefghijklmnopqrstuvwxyz", "東京都人々使紅葉山川田中大小上下左右前後火水木金土日"


@query("cjk_gram_channel", f"""WITH d AS (SELECT doc_id AS id, translate(lower(text), '{_LETTERS}', '{_HAN}') AS content FROM documents), b AS (SELECT item_id AS query_id, translate(lower(text), '{_LETTERS}', '{_HAN}') AS text FROM benchmark),
r AS (SELECT query_id, unnest(regexp_extract_all(text, '[{_HAN}]+')) AS run, generate_subscripts(regexp_extract_all(text, '[{_HAN}]+'), 1) AS pos FROM b), n AS (SELECT query_id, pos, unnest(range(1, greatest(1, length(run) - 2) + 1)) AS i, run FROM r WHERE length(run) >= 2), m AS (SELECT query_id, substr(run, i, 3) AS gram, min(pos * 100000 + i) AS place FROM n GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM m) WHERE k <= 24), c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM g)
SELECT query_id, id, sum(length(gram))::BIGINT AS total, count(*) AS hits FROM d JOIN c ON contains(content, gram) GROUP BY 1, 2 HAVING count(*) >= least(2, max(n))""")
def cjk_gram_channel(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no CJK text, so letters are read as ideographs."""
    han = lambda c: F.translate(F.lower(c), _LETTERS, _HAN)
    docs = _memories(spark, d).select("id", han("content").alias("content"))
    return S.gram_hits(docs, _queries(spark, d).select("query_id", X.cjk_grams(han("text")).alias("grams"))).select("query_id", "id", "total", "hits")


_SEM = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
m AS (SELECT q.vec_id AS query_id, d.vec_id AS id, 1 - list_dot_product(d.e, q.e) / (d.norm * q.norm) AS distance FROM n q JOIN n d ON q.vec_id % 50 = 0 WHERE 1 - list_dot_product(d.e, q.e) / (d.norm * q.norm) <= 0.9)"""


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    # the stated query set: every vector whose id is divisible by 50, against all vectors
    return S.semantic(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 0.9)


@query("semantic_topk", f"WITH {_SEM} SELECT query_id, id, rank, round(distance, 6) + 0.0 AS distance FROM (SELECT *, {_rank('distance', down=False)} AS rank FROM m) WHERE rank <= 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.ranked(_semantic(spark, d), F.round("distance", 9), F.col("id"), limit=LIMIT)
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


_HYBRID = f"""{_WITH}, {_STRICT}, {_RELAXED}, c AS (SELECT query_id, id, {_rank()} AS rank FROM s UNION ALL SELECT query_id, id, {_rank()} FROM r),
f AS (SELECT query_id, id, sum(1.0 / (60.0 + rank)) AS score, count(*) AS channels FROM c WHERE rank <= 80 GROUP BY 1, 2), h AS (SELECT *, {_rank()} AS rank FROM f)"""


def hybrid(spark: SparkSession, d: str, limit: int = LIMIT) -> DataFrame:
    """Strict and relaxed channels, each cut to four times the limit, fused and ranked; one pass over the documents."""
    hits = S.hits(_memories(spark, d), _queries(spark, d), ("strict", "relaxed"), 4 * limit)
    order = (F.desc(F.round("score", 9)), F.col("id"))
    each = R.ranked(hits, *order, by=["query_id", "channel"], limit=4 * limit)
    return R.ranked(R.fused([each]), *order, limit=limit)


@query("hybrid_search", f"{_HYBRID} SELECT query_id, id, rank, channels, round(score, 6) AS score FROM h WHERE rank <= 20")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "channels", F.round("score", 6).alias("score"))


def searched(spark: SparkSession, d: str, limit: int = LIMIT, with_aliases: bool = False, whole: bool = False) -> DataFrame:
    """The whole memory search: every channel over chunks (or ``whole`` memories), what the query's user may read, memories by their best chunk.

    Query q is asked by user q mod 25 and has the vector q; the vector of a memory's first chunk is the one with its id.
    """
    m = V.memories(spark, d).select("id", "workspace_id", "owner_id", "scope", "updated_at", "content")
    qs = _queries(spark, d).withColumn("user_id", F.col("query_id") % 25)
    e = table(spark, d, "embeddings")
    wanted = e.select(F.col("vec_id").alias("query_id"), "embedding").join(qs.select("query_id"), "query_id", "left_semi")
    vectors = e.select(F.col("vec_id").alias("id"), "embedding").join(m.drop("content"), "id").withColumn("ordinal", F.lit(0))
    pieces = m.withColumnRenamed("content", "chunk").withColumn("ordinal", F.lit(0)) if whole else chunked(m)
    return S.memory_search(pieces, qs, V.memberships(spark, d), vectors, wanted, limit, 0.9, with_aliases)


@query("memory_search")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("recency_fusion", f"""{_HYBRID}, t AS (SELECT h.query_id, h.id, h.rank, row_number() OVER (PARTITION BY query_id ORDER BY m.updated_at DESC, h.id) AS recency_rank FROM h JOIN ({V.MEMORIES_SQL}) m ON m.id = h.id WHERE h.rank <= 20)
SELECT query_id, id, round(0.4 / (60 + rank) + 0.6 / (60 + recency_rank), 6) AS score FROM t""")
def recency_fusion(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d).select("id", "updated_at")
    return R.recency_fused(hybrid(spark, d).join(m, "id"), 0.6).select("query_id", "id", F.round("score", 6).alias("score"))


@query("rerank_fusion", f"""{_HYBRID}, t AS (SELECT h.*, (h.id % 97) / 97.0 AS rerank_score FROM h WHERE rank <= 20), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS rerank_rank FROM t WHERE rerank_score >= 0.25)
SELECT query_id, id, rerank_rank, round(0.75 / (60 + rerank_rank) + 0.25 / (60 + rank), 6) AS score FROM k""")
def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    scored = hybrid(spark, d).withColumn("rerank_score", (F.col("id") % 97) / 97.0)
    return R.rerank_fused(scored, 0.75, 0.25).select("query_id", "id", F.col("rerank_rank").cast("long").alias("rerank_rank"), F.round("score", 6).alias("score"))


@query("multi_query_fusion", f"""{_WITH}, {_RELAXED}, x AS (SELECT query_id // 4 AS topic, query_id, id, {_rank()} AS rank FROM r), y AS (SELECT * FROM x WHERE rank <= 20)
SELECT topic, id, round(sum(1.0 / (60 + rank)), 6) AS score, min(rank) AS best_rank, arg_min(query_id, rank * 1000000 + query_id) AS first_query FROM y GROUP BY 1, 2""")
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = relaxed_hits(spark, d, LIMIT).withColumn("topic", F.floor(F.col("query_id") / 4))
    return R.query_fused(hits, by="topic", source="query_id").select("topic", "id", F.round("score", 6).alias("score"), F.col("best_rank").cast("long").alias("best_rank"), "first_query")


@query("ranking_metrics", f"""{_HYBRID}, x AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))), e AS (SELECT query_id, count(*) AS n_expected FROM x GROUP BY 1),
g AS (SELECT h.query_id, count(x.id) AS n_found, min(CASE WHEN x.id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN x.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE l.toxic = 1) AS n_forbidden FROM h LEFT JOIN x ON x.query_id = h.query_id AND x.id = h.id LEFT JOIN labels l ON l.doc_id = h.id WHERE rank <= 20 GROUP BY 1)
SELECT g.query_id, coalesce(n_expected, 0) AS n_expected, round(coalesce(n_found / n_expected, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(n_expected, 20) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, n_forbidden = 0 AS isolated FROM g LEFT JOIN e USING (query_id)""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluation import ranking_metrics as metrics

    docs, qs = _memories(spark, d), _queries(spark, d)
    expected = S.phrase(docs, qs)
    forbidden = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    return metrics(hybrid(spark, d), expected, forbidden, LIMIT)


@query("evidence_windows")
def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = _memories(spark, d)
    best = S.best_relaxed(chunked(docs).select(F.concat_ws(":", "id", "ordinal").alias("id"), F.col("chunk").alias("content")), _queries(spark, d), LIMIT)
    anchors = saved(best.select("query_id", F.split("id", ":")[0].cast("long").alias("id"), F.split("id", ":")[1].cast("int").alias("ordinal")))
    # a few anchors a query of the stated set: only their documents are cut into pieces again
    got = S.evidence(chunked(docs.join(F.broadcast(anchors.select("id").distinct()), "id", "left_semi")), anchors)
    return got.select("query_id", "id", "n_chunks", F.md5(F.col("evidence").cast("binary")).alias("digest"))


@query("diverse_results")
def diverse_results(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.diversity import diversified

    # a few hits a query of the stated set are broadcast; texts stay where they are read
    hits = _memories(spark, d).withColumnRenamed("content", "evidence").join(F.broadcast(searched(spark, d)), "id")
    return diversified(hits, 10, 0.6)


@query("bm25_topk", r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ts FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM benchmark) GROUP BY 1, 2),
b AS (SELECT query_id, tf.id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN t ON t.id = tf.id CROSS JOIN st GROUP BY 1, 2)
SELECT query_id, id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, id DESC) AS rank FROM b) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(_memories(spark, d), _queries(spark, d), X.ascii_tokens(F.col("content")), X.ascii_tokens(F.col("text")))
    top = R.ranked(hits, F.desc(F.round("score", 7)), F.desc("id"), limit=10)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("episode_summary", """SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def episode_summary(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), parts.alias("p"))
    return got.select("conv_id", "n_turns", "n_chars", "first_turn", "last_turn", F.concat_ws(",", F.transform("p", lambda x: x["role"])).alias("roles"), F.md5(F.concat_ws("", F.transform("p", lambda x: x["text"])).cast("binary")).alias("digest"))


_EPI = _POST.replace("doc_id AS id", "conv_id * 1000 + turn AS id").replace("FROM documents", "FROM conversations")


@query("episode_search", f"""WITH {_EPI}, {_TERMS}, {_RELAXED}, h AS (SELECT *, {_rank()} AS rank FROM r) SELECT query_id, id // 1000 AS conv_id, round(max(1.0 / (60 + rank)), 6) AS score, count(*) AS n_turns FROM h WHERE rank <= 40 GROUP BY 1, 2""")
def episode_search(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    hits = S.best_relaxed(turns, _queries(spark, d), 40)
    each = hits.select("query_id", F.floor(F.col("id") / 1000).alias("conv_id"), (1.0 / (60 + F.col("rank"))).alias("score"))
    return each.groupBy("query_id", "conv_id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n_turns"))


@query("versioned_facts", r"""WITH f AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark), g AS (SELECT item_id, (pos // 6)::BIGINT AS serial, string_agg(word, ' ' ORDER BY pos) AS fact FROM f GROUP BY 1, 2), k AS (SELECT split_part(fact, ' ', 1) AS subject, item_id * 1000 + serial AS serial, fact FROM g)
SELECT subject, max(serial) AS serial, arg_max(fact, serial) AS fact, count(*) AS n_versions FROM k GROUP BY 1""")
def versioned_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts keyed by their first word; of several the highest serial wins."""
    f = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    parts = F.array_sort(F.collect_list(F.struct("at", "word")))
    g = f.groupBy("item_id", F.floor((F.col("at") + 1) / 6).alias("k")).agg(F.concat_ws(" ", F.transform(parts, lambda p: p["word"])).alias("fact"))
    k = g.select(F.split("fact", " ")[0].alias("subject"), (F.col("item_id") * 1000 + F.col("k")).alias("serial"), "fact")
    return k.groupBy("subject").agg(F.max("serial").alias("serial"), F.max_by("fact", "serial").alias("fact"), F.count("*").alias("n_versions"))


@query("token_f1", r"""WITH t AS (SELECT a.conv_id, a.turn, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(a.text, ',', '')), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the|and)\b', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM conversations a),
c AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS word FROM t) WHERE word <> '' GROUP BY 1, 2, 3), l AS (SELECT conv_id, turn, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2),
o AS (SELECT p.conv_id, p.turn, sum(least(p.n, r.n))::BIGINT AS common FROM c p JOIN c r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 AND r.word = p.word GROUP BY 1, 2)
SELECT a.conv_id, a.turn, round(2.0 * common / (a.n + b.n), 6) AS f1 FROM o JOIN l a USING (conv_id, turn) JOIN l b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evaluation import token_overlap

    c = table(spark, d, "conversations").select("conv_id", "turn", X.normalized_answer(F.col("text")).alias("answer"))
    return token_overlap(c, c.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 6).alias("f1"))

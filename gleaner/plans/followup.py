"""Queries after a first ranking: normalised queries, context groups, feedback, benchmark summaries and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access
from ..operators import context as C
from ..operators import ranking as R
from ..operators import retrieval as S
from ..sources import views as V
from ..sources.tables import table
from .registry import query
from .retrieval import _HYBRID, _POST, _RELAXED, _SEM, _TERMS, _WITH, _memories, _queries, _rank, _semantic, hybrid, relaxed_hits

_STOPS = ", ".join(f"'{w}'" for w in C.FEEDBACK_STOPS)
_WORDS = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''-]*)', 1)"
_TELLING = f"list_filter(list_distinct({_WORDS}), lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))"


@query("normalized_queries", r"""WITH t AS (SELECT conv_id AS query_id, turn AS ordinal, substr(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 2000) AS text FROM conversations),
f AS (SELECT query_id, min(ordinal) AS ordinal, arg_min(text, ordinal) AS text FROM t WHERE text <> '' GROUP BY query_id, lower(text)) SELECT query_id, position, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) AS position FROM f) WHERE position <= 4""")
def normalized_queries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ordinal"), "text")
    return C.normalized_queries(c, 4).select("query_id", "position", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("context_group_expansion", f"""{_WITH}, {_RELAXED}, m AS (SELECT doc_id AS id, source AS grp, doc_id AS ordinal, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS updated_at FROM documents),
h AS (SELECT query_id, id, rank, round(score, 9) AS score FROM (SELECT *, {_rank()} AS rank FROM r) WHERE rank <= 10), b AS (SELECT h.query_id, h.rank, m.* FROM h JOIN m USING (id) WHERE rank <= 4 AND grp IS NOT NULL),
g AS (SELECT query_id, grp, min(rank) AS group_rank FROM b GROUP BY 1, 2),
o AS (SELECT m.*, g.query_id, g.group_rank FROM m JOIN g USING (grp) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = g.query_id AND h.id = m.id)),
x AS (SELECT o.query_id, o.id, o.group_rank, min(abs(o.ordinal - b.ordinal)) AS distance FROM o JOIN b ON b.query_id = o.query_id AND b.grp = o.grp GROUP BY 1, 2, 3),
e AS (SELECT query_id, id, CASE WHEN rank <= 4 THEN 0 ELSE 2 END AS part, rank AS place FROM h UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY distance, group_rank, id) FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS rank FROM e) SELECT query_id, id, rank, CASE part WHEN 0 THEN 'base' WHEN 1 THEN 'context' ELSE 'rest' END AS kind FROM f WHERE rank <= 8""")
def context_group_expansion(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d).select("id", F.col("source").alias("group"), F.col("id").alias("ordinal"), "updated_at")
    got = C.context_groups(relaxed_hits(spark, d, 10).select("query_id", "id", "rank", "score"), m, 8, 4)
    return got.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "kind")


@query("feedback_queries", rf"""{_WITH}, {_RELAXED}, h AS (SELECT query_id, id, rank FROM (SELECT *, {_rank()} AS rank FROM r) WHERE rank <= 3), a AS (SELECT h.*, b.text, d.text AS evidence, {_TELLING.format('b.text')} AS terms FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id),
p0 AS (SELECT query_id, id, terms, unnest(regexp_extract_all(evidence, '([^.!?。！？]+(?:[.!?。！？]+|$))', 1)) AS passage, generate_subscripts(regexp_extract_all(evidence, '([^.!?。！？]+(?:[.!?。！？]+|$))', 1), 1) - 1 AS pos FROM a), p1 AS (SELECT query_id, id, terms, pos, regexp_replace(passage, '^\s+|\s+$', '', 'g') AS passage FROM p0),
p2 AS (SELECT query_id, id, pos, passage, coalesce(list_sum(list_transform(list_intersect(terms, {_WORDS.format('passage')}), lambda w: least(length(w), 12))), 0) / sqrt(greatest(1, least(length(passage), 500))) - pos / 1e6 AS o FROM p1), pz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY o DESC, pos) AS k FROM p2) WHERE k = 1),
q1 AS (SELECT a.query_id, a.id, a.rank, a.text, substr(CASE WHEN pz.o > 0 AND len(a.terms) > 0 THEN pz.passage ELSE a.evidence END, 1, 1000) AS excerpt FROM a LEFT JOIN pz USING (query_id, id) WHERE trim(a.evidence) <> ''),
q2 AS (SELECT query_id, id, rank, regexp_replace(regexp_replace(substr(text, 1, 1000) || chr(10) || excerpt, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS query FROM q1 WHERE len(list_filter({_TELLING.format('excerpt')}, lambda w: NOT list_contains({_WORDS.format('text')}, w))) > 0),
q3 AS (SELECT query_id, lower(query) AS key, arg_min(id, rank) AS id, arg_min(query, rank) AS query, min(rank) AS rank FROM q2 GROUP BY 1, 2) SELECT query_id, id AS excluded_id, md5(query) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM q3) WHERE k <= 2""")
def feedback_queries(spark: SparkSession, d: str) -> DataFrame:
    top = relaxed_hits(spark, d, 3).select("query_id", "id", "rank").join(_queries(spark, d), "query_id")
    hits = _memories(spark, d).withColumnRenamed("content", "evidence").join(F.broadcast(top), "id")  # three hits a query
    return C.feedback_queries(hits, 2).select("query_id", "excluded_id", F.md5(F.col("query").cast("binary")).alias("digest"))


@query("feedback_tail", f"""{_WITH}, {_RELAXED}, h AS (SELECT query_id, id, rank FROM (SELECT *, {_rank()} AS rank FROM r) WHERE rank <= 12), a AS (SELECT * FROM h WHERE rank <= 10 AND NOT (query_id % 3 = 0 AND rank > 5)), n AS (SELECT y.query_id, y.id, row_number() OVER (PARTITION BY y.query_id ORDER BY y.rank, y.id) AS k FROM (SELECT query_id - 1 AS query_id, id, rank FROM h) y WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = y.query_id AND a.id = y.id)),
c AS (SELECT query_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT query_id, count(*) AS n FROM a GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS m FROM n GROUP BY 1) USING (query_id)), s AS (SELECT query_id, least(m, greatest(10 - n, least(m, 2))) AS slots FROM c),
e AS (SELECT query_id, id, 0 AS part, rank AS k FROM a JOIN s USING (query_id) WHERE rank <= 10 - slots UNION ALL SELECT query_id, id, 1, k FROM n JOIN s USING (query_id) WHERE k <= slots) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, k) AS position FROM e""")
def feedback_tail(spark: SparkSession, d: str) -> DataFrame:
    """The next query's hits stand for a feedback query's; every third query has a short first ranking."""
    h = relaxed_hits(spark, d, 12).select("query_id", "id", "rank")
    first = h.where("rank <= 10 and not (query_id % 3 = 0 and rank > 5)")
    return C.feedback_tail(first, h.withColumn("query_id", F.col("query_id") - 1), 10).select("query_id", "id", F.col("position").cast("long").alias("position"))


_EXPECTED = "x AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))"


@query("benchmark_summary", f"""{_HYBRID}, {_EXPECTED}, k AS (SELECT b.item_id AS query_id, (SELECT count(*) FROM x WHERE x.query_id = b.item_id) AS n_expected, (SELECT count(*) FROM h WHERE h.query_id = b.item_id AND rank <= 20) AS n_found,
(SELECT count(*) FROM h JOIN x USING (query_id, id) WHERE h.query_id = b.item_id AND rank <= 20) AS n_hit, (SELECT count(*) FROM h JOIN x USING (query_id, id) WHERE h.query_id = b.item_id AND rank = 1) AS n_first, (SELECT min(rank) FROM h JOIN x USING (query_id, id) WHERE h.query_id = b.item_id AND rank <= 20) AS best FROM benchmark b)
SELECT count(*) FILTER (WHERE n_expected > 0) AS positive_cases, count(*) FILTER (WHERE n_expected = 0) AS no_answer_cases, round(avg(n_first / n_expected) FILTER (WHERE n_expected > 0), 6) AS recall_at_one, round(avg(n_hit / n_expected) FILTER (WHERE n_expected > 0), 6) AS recall_at_k,
round(avg(coalesce(1 / best, 0)) FILTER (WHERE n_expected > 0), 6) AS reciprocal_rank, round(avg(CASE WHEN n_found = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_expected = 0), 6) AS no_answer_accuracy, round(avg(n_found) FILTER (WHERE n_expected = 0), 6) AS false_results FROM k""")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """Positive and no-answer cases of the benchmark, judged and averaged."""
    docs, qs = _memories(spark, d), _queries(spark, d)
    expected = S.phrase(docs, qs).withColumn("hit", F.lit(1))
    h = hybrid(spark, d).select("query_id", "id", "rank").join(expected, ["query_id", "id"], "left")
    per = h.groupBy("query_id").agg(F.count("*").alias("n_found"), F.count("hit").alias("n_hit"), F.count(F.when((F.col("rank") == 1) & F.col("hit").isNotNull(), 1)).alias("n_first"), F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("best"))
    want = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    k = qs.select("query_id").join(want, "query_id", "left").join(per, "query_id", "left").fillna(0, ["n_expected", "n_found", "n_hit", "n_first"])
    positive, none = F.col("n_expected") > 0, F.col("n_expected") == 0
    mean = lambda c, when: F.round(F.avg(F.when(when, c)), 6)
    return k.agg(
        F.count_if(positive).alias("positive_cases"), F.count_if(none).alias("no_answer_cases"), mean(F.col("n_first") / F.col("n_expected"), positive).alias("recall_at_one"), mean(F.col("n_hit") / F.col("n_expected"), positive).alias("recall_at_k"),
        mean(F.coalesce(1 / F.col("best"), F.lit(0.0)), positive).alias("reciprocal_rank"), mean(F.when(F.col("n_found") == 0, 1.0).otherwise(0.0), none).alias("no_answer_accuracy"), mean(F.col("n_found").cast("double"), none).alias("false_results"),
    )


@query("threshold_sweep", f"WITH {_SEM}, t(threshold) AS (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) SELECT CAST(threshold AS DOUBLE) AS threshold, count(id) AS n_hits, count(DISTINCT query_id) AS n_answered FROM t LEFT JOIN m ON m.distance <= threshold GROUP BY 1")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """One product of the stated queries, judged at every threshold of the grid."""
    grid = F.array(*map(F.lit, (0.5, 0.6, 0.7, 0.8, 0.9)))
    hits = _semantic(spark, d).select("query_id", F.explode(F.filter(grid, lambda t: t >= F.col("distance"))).alias("threshold"))
    counts = hits.groupBy("threshold").agg(F.count("*").alias("n_hits"), F.countDistinct("query_id").alias("n_answered"))
    return spark.range(1).select(F.explode(grid).alias("threshold")).join(counts, "threshold", "left").fillna(0)


@query("score_distribution", f"""{_WITH}, {_RELAXED}, b AS (SELECT item_id AS query_id, (SELECT max(round(score, 6)) FROM r WHERE r.query_id = item_id) AS score FROM benchmark), s AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM b WHERE score IS NOT NULL)
SELECT (SELECT count(score) FROM b) AS n, (SELECT count(*) - count(score) FROM b) AS n_empty, min(score) AS low, max(CASE WHEN k = greatest(1, ceil(0.05 * n)) THEN score END) AS p05, max(CASE WHEN k = greatest(1, ceil(0.5 * n)) THEN score END) AS p50, max(CASE WHEN k = greatest(1, ceil(0.95 * n)) THEN score END) AS p95, max(score) AS high FROM s""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    best = relaxed_hits(spark, d, 1).groupBy("query_id").agg(F.max(F.round("score", 6)).alias("score"))
    b = _queries(spark, d).select("query_id").join(best, "query_id", "left")
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by score)")
    return b.agg(F.count("score").alias("n"), (F.count("*") - F.count("score")).alias("n_empty"), F.min("score").alias("low"), at(0.05).alias("p05"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("score").alias("high"))


def _found_by(asked: str, name: str) -> str:
    """The relaxed channel's hits of a table of queries as CTEs; the last one has the given name."""
    steps = f"{_TERMS}, {_RELAXED}".replace("item_id AS query_id", "query_id").replace("FROM benchmark", f"FROM {asked}")
    for old in ("w0", "w1", "w2"):
        steps = steps.replace(f"{old} AS (", f"{name}_{old} AS (").replace(f"FROM {old}", f"FROM {name}_{old}")
    return steps.replace("\nq AS (", f"\n{name}_q AS (").replace("JOIN q USING", f"JOIN {name}_q USING").replace("r AS (SELECT query_id, id", f"{name} AS (SELECT query_id, id")


#: Members that have left before the second round.
_LEFT = "user_id % 5 = 0"


@query("feedback_rounds", f"""WITH {_POST}, mem AS ({V.MEMORIES_SQL}), mb AS (SELECT user_id, workspace_id FROM ({V.MEMBERSHIPS_SQL}) WHERE status = 'active'),
v1 AS (SELECT user_id, id FROM mem JOIN mb USING (workspace_id) WHERE scope = 'shared' OR owner_id = user_id), v2 AS (SELECT * FROM v1 WHERE NOT {_LEFT}),
b AS (SELECT item_id AS query_id, item_id % 25 AS user_id, text FROM benchmark WHERE item_id % 25 IN (SELECT user_id FROM v1)), {_found_by("b", "x1")},
h1 AS (SELECT query_id, user_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM x1 JOIN b USING (query_id) SEMI JOIN v1 USING (user_id, id) QUALIFY rank <= 5),
b2 AS (SELECT query_id, user_id, substr(content, 1, 80) AS text, h1.id AS excluded_id FROM h1 JOIN mem USING (id) WHERE rank = 1 AND user_id IN (SELECT user_id FROM v2)), {_found_by("b2", "x2")},
h2 AS (SELECT query_id, user_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM x2 JOIN b2 USING (query_id) SEMI JOIN v2 USING (user_id, id) WHERE id <> excluded_id QUALIFY rank <= 5)
SELECT query_id, id, 1 AS round, rank, round(score, 6) AS score FROM h1 SEMI JOIN v2 USING (user_id, id) UNION ALL SELECT query_id, id, 2, rank, round(score, 6) FROM h2""")
def feedback_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds: passages, then the beginning of each best memory; some members leave in between and get nothing from then on."""
    docs, m, members = _memories(spark, d), V.memories(spark, d), V.memberships(spark, d)

    def search(asked: DataFrame, readable: DataFrame) -> DataFrame:
        readers = readable.join(asked.select("user_id").distinct(), "user_id", "left_semi").groupBy("id").agg(F.collect_set("user_id").alias("readers"))
        # one hit more than is ranked: the excluded memory may be among them
        return S.hits(docs.join(readers, "id"), asked, ("relaxed",), 6).select("query_id", "id", "score")

    def ask_again(hits: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(hits.where("rank = 1")), "id").select("query_id", F.substring("content", 1, 80).alias("text"), F.col("id").alias("excluded_id"))

    now = lambda rows: lambda: access.visible(m, rows).select("user_id", "id")
    rights = [now(members), now(members.where(f"not {_LEFT}"))]
    asked = _queries(spark, d).withColumn("user_id", F.col("query_id") % 25)
    got = C.search_rounds(search, ask_again, asked, rights, 5, told_rights=True)
    return got.select("query_id", "id", "round", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))

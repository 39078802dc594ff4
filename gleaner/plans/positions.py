"""Queries over positional postings: cover density of the lexical channels, and literal answers near a query's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemmer import STOP_WORDS, stem_sql
from ..operators import positions as P
from ..sources import views as V
from .registry import query
from .retrieval import _RELAXED, _SEM, _WITH, _memories, _queries, searched

_WORDS = r"regexp_extract_all(lower({t}), '([\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''-]*)', 1)"
_PLACES = f"pos AS (SELECT doc_id AS id, unnest({_WORDS.format(t='text')}) AS term, generate_subscripts({_WORDS.format(t='text')}, 1) AS place FROM documents)"
_ASKED = f"SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format(t='text')}) AS term FROM benchmark"
#: From entries e (query_id, id, term, at) and the asked terms q (query_id, term): last place of each term up to each entry, their least begins the window.
_COVERS = """n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), whole AS (SELECT query_id, id FROM e JOIN n USING (query_id) GROUP BY 1, 2 HAVING count(DISTINCT term) = max(n)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place) AS i FROM e SEMI JOIN whole USING (query_id, id)),
l AS (SELECT x.query_id, x.id, x.i, x.place, y.term, max(y.i) AS li FROM f x JOIN f y ON x.query_id = y.query_id AND x.id = y.id AND y.i <= x.i GROUP BY ALL),
m AS (SELECT query_id, id, i, place, min(li) AS low FROM l JOIN n USING (query_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = max(n)),
c AS (SELECT m.*, f.place AS begins, coalesce(lag(m.low) OVER (PARTITION BY m.query_id, m.id ORDER BY m.i), 0) AS before FROM m JOIN f ON f.query_id = m.query_id AND f.id = m.id AND f.i = m.low)
SELECT query_id, id, round(w / (w + 1), 6) AS score FROM (SELECT query_id, id, sum(0.1::DOUBLE / (1 + (place - begins) - (i - low))) AS w FROM c WHERE low > before GROUP BY 1, 2)"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("cover_density", f"WITH {_PLACES}, q AS ({_ASKED}), e AS (SELECT query_id, id, term, place FROM pos JOIN q USING (term)), {_COVERS}")
def cover_density(spark: SparkSession, d: str) -> DataFrame:
    """The strict channel's documents ranked as a lexical index ranks them: by the windows that cover the query."""
    return P.simple_cover_density(_memories(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 6))


@query("english_cover_density", f"""WITH {_PLACES}, v AS (SELECT DISTINCT term FROM pos WHERE term NOT IN ({_STOPS})), vs AS ({stem_sql("v")}), b AS (SELECT * FROM ({_ASKED}) WHERE term NOT IN ({_STOPS})),
q AS (SELECT DISTINCT query_id, stem AS term FROM ({stem_sql("b")})), e AS (SELECT query_id, id, q.term, place FROM pos JOIN vs USING (term) JOIN q ON q.term = vs.stem), {_COVERS}""")
def english_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return P.english_cover_density(_memories(spark, d), _queries(spark, d)).withColumn("score", F.round("score", 6))


_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[\p{{P}}\p{{S}}]', '', 'g'), '\b(?:a|an|the)\b', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_ANCHOR = "CASE WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' WHEN length({t}) > 4 AND {t} LIKE '%es' THEN {t}[:-3] WHEN length({t}) > 3 AND {t} LIKE '%s' THEN {t}[:-2] ELSE {t} END"
_NO_ANCHOR = ", ".join(f"'{w}'" for w in P.ANCHOR_STOPS)
_HAY = "(SELECT query_id, id, needle, kind, part, pos, sum(length(part) + length(needle)) OVER (PARTITION BY query_id, id, kind, needle ORDER BY pos) - length(needle) / 2 AS centre FROM (SELECT query_id, id, kind, needle, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos, len(parts) AS n FROM (SELECT query_id, id, kind, needle, string_split(normal, needle) AS parts FROM needles)) WHERE pos < n)"


@query("literal_answers", rf"""WITH b AS (SELECT item_id AS query_id, text, regexp_extract_all(text, '([\p{{L}}\p{{N}}]+)', 1) AS w FROM benchmark),
d AS (SELECT doc_id AS id, {_BARE.format(t='text')} AS normal FROM documents),
r AS (SELECT DISTINCT query_id, ref FROM (SELECT query_id, {_BARE.format(t='ref')} AS ref FROM (SELECT query_id, unnest([w[len(w)], w[3] || ' ' || w[4], (query_id % 100)::VARCHAR]) AS ref FROM b)) WHERE length(ref) >= 3 OR regexp_full_match(ref, '[0-9]+')),
a AS (SELECT query_id, {_ANCHOR.format(t='t')} AS term, max(CASE WHEN regexp_matches(word, '^\p{{Lu}}') THEN 2 ELSE 1 END) AS weight FROM (SELECT query_id, unnest(w) AS word, unnest(list_transform(w, lambda x: lower(x))) AS t FROM b) WHERE length(t) > 2 AND t NOT IN ({_NO_ANCHOR}) GROUP BY 1, 2),
h AS (SELECT query_id, id, normal, max(length(ref)) AS longest FROM r JOIN d ON contains(normal, ref) GROUP BY ALL),
k AS (SELECT DISTINCT id, {_ANCHOR.format(t='t')} AS term FROM (SELECT id, unnest(string_split(normal, ' ')) AS t FROM d) WHERE length(t) > 2 AND t NOT IN ({_NO_ANCHOR})),
o AS (SELECT h.query_id, h.id, sum(weight * least(length(term), 12)) AS overlap FROM h JOIN k USING (id) JOIN a USING (query_id, term) GROUP BY 1, 2),
s AS (SELECT query_id, id, normal, (coalesce(overlap, 0) + least(longest, 24))::BIGINT AS score FROM h LEFT JOIN o USING (query_id, id)),
t AS (SELECT * FROM s QUALIFY score = max(score) OVER (PARTITION BY query_id)),
needles AS (SELECT query_id, id, normal, 'r' AS kind, ref AS needle FROM t JOIN r USING (query_id) WHERE contains(normal, ref) UNION ALL SELECT query_id, id, normal, 't', term FROM t JOIN a USING (query_id)),
p AS {_HAY}, g AS (SELECT x.query_id, x.id, min(abs(x.centre - y.centre)) AS distance FROM p x JOIN p y ON x.query_id = y.query_id AND x.id = y.id AND x.kind = 'r' AND y.kind = 't' GROUP BY 1, 2)
SELECT query_id, id, score, distance FROM (SELECT t.query_id, t.id, score, distance, row_number() OVER (PARTITION BY t.query_id ORDER BY coalesce(distance, 1e300), t.id) AS k FROM t LEFT JOIN g USING (query_id, id)) WHERE k = 1""")
def literal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents the one that answers each passage: its last word, a pair of its words, or its number."""
    w = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1)
    word = lambda i: F.try_element_at("w", F.lit(i))
    asks = _queries(spark, d).withColumn("w", w).select("query_id", "text", F.array_compact(F.array(word(-1), F.concat_ws(" ", word(3), word(4)), (F.col("query_id") % 100).cast("string"))).alias("references"))
    return P.literal_answers(_memories(spark, d), asks)


def _covers(prefix: str, entries: str, asked: str) -> str:
    """The cover-density hits of a channel as {prefix}hit (query_id, id, score), from its entries and asked terms."""
    steps = _COVERS.replace("FROM q ", f"FROM {asked} ").replace("FROM e ", f"FROM {entries} ")
    for name in ("n", "whole", "f", "l", "m", "c"):
        steps = steps.replace(f"{name} AS (", f"{prefix}{name} AS (")
    for old, new in (("JOIN n ", "JOIN {p}n "), ("SEMI JOIN whole", "SEMI JOIN {p}whole"), ("FROM f x JOIN f y", "FROM {p}f x JOIN {p}f y"), ("FROM l JOIN", "FROM {p}l JOIN"), ("FROM m JOIN f ON f.query_id = m.query_id AND f.id = m.id AND f.i = m.low", "FROM {p}m m JOIN {p}f f ON f.query_id = m.query_id AND f.id = m.id AND f.i = m.low"), ("FROM c WHERE", "FROM {p}c WHERE")):
        steps = steps.replace(old, new.format(p=prefix))
    body, last = steps.rsplit("\nSELECT", 1)
    return f"{body},\n{prefix}hit AS (SELECT{last})".replace("round(w / (w + 1), 6)", "w / (w + 1)")


@query("memory_search_whole", f"""{_WITH}, {_RELAXED}, {_SEM.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)").replace("q AS", "sq AS")}, {_PLACES}, sasked AS ({_ASKED}), se AS (SELECT query_id, id, term, place FROM pos JOIN sasked USING (term)), {_covers("s", "se", "sasked")},
ev AS (SELECT DISTINCT term FROM pos WHERE term NOT IN ({_STOPS})), evs AS ({stem_sql("ev")}), eb AS (SELECT * FROM ({_ASKED}) WHERE term NOT IN ({_STOPS})), easked AS (SELECT DISTINCT query_id, stem AS term FROM ({stem_sql("eb")})), ee AS (SELECT query_id, id, easked.term, place FROM pos JOIN evs USING (term) JOIN easked ON easked.term = evs.stem), {_covers("e", "ee", "easked")},
every AS (SELECT query_id, id, 'simple' AS channel, score FROM shit UNION ALL SELECT query_id, id, 'english', score FROM ehit UNION ALL SELECT query_id, id, 'relaxed', score FROM r UNION ALL SELECT query_id, id, 'semantic', -distance FROM m),
mem AS ({V.MEMORIES_SQL}), mb AS ({V.MEMBERSHIPS_SQL}), seen AS (SELECT every.*, updated_at FROM every JOIN mem USING (id) JOIN mb ON mb.user_id = query_id % 25 AND mb.workspace_id = mem.workspace_id AND status = 'active' WHERE scope = 'shared' OR owner_id = mb.user_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, updated_at DESC, id) AS rank FROM seen QUALIFY rank <= 80), fused AS (SELECT query_id, id, updated_at, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked GROUP BY ALL)
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, updated_at DESC, id) AS rank FROM fused) WHERE rank <= 20""")
def memory_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """``memory_search`` with each memory as one chunk, so that SQL sees what its channels see: authorisation, cover density, stems, vectors, fusion."""
    return searched(spark, d, whole=True).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))

"""Aggregations, graph analytics and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import views as V
from ..sources.sinks import export_manifest
from ..sources.tables import table
from .registry import query

#: Accuracy of a percentile sketch: its ranks are off by at most 1 / SKETCH of the rows.
SKETCH = 10_000


@query("type_source_counts", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, sum(value) AS total FROM events GROUP BY 1""".replace("sum(value)", "round(sum(value), 4)"))
def type_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total"))


@query("daily_activity", """WITH b AS (SELECT max(CAST(ts AS DATE)) AS last FROM events), days AS (SELECT unnest(generate_series(last - INTERVAL 179 DAY, CAST(last AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day FROM b), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (day)""")
def daily_activity(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last = counts.agg(F.max("day").alias("last"))  # one row
    days = last.select(F.explode(F.sequence(F.date_sub("last", 179), F.col("last"))).alias("day"))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN k = ceil(0.5 * n) THEN value END) AS p50, max(CASE WHEN k = ceil(0.95 * n) THEN value END) AS p95, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) + 1 THEN value END) AS p95_floor FROM r GROUP BY 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Two definitions: nearest rank ceil(p n), and the element at index min(n - 1, floor(n p)).

    A bounded sketch gives each type an interval that surely holds the value; what lies below is counted, and only
    the interval's values, a small share of the rows, are ranked by their counts.
    """
    e = table(spark, d, "events").select("event_type", "value").where("value is not null")
    at = F.expr(f"approx_percentile(value, array(0.4996, 0.5004, 0.9496, 0.9504), {SKETCH})")
    spread = e.groupBy("event_type").agg(F.count("*").alias("n"), at.alias("a"), F.min("value").alias("low"), F.max("value").alias("high"))
    n = F.col("n")
    # ranks are looked for between two sketched ones; with few rows the sketch is exact and the ends may be missed by one
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), k.cast("long").alias("k"), F.when(n < SKETCH, F.col("low")).otherwise(F.col("a")[i]).alias("from"), F.when(n < SKETCH, F.col("high")).otherwise(F.col("a")[i + 1]).alias("to")) for name, k, i in (
        ("p50", F.ceil(0.5 * n), 0), ("p95", F.ceil(0.95 * n), 2), ("p95_floor", F.least(n - 1, F.floor(n * 0.95)) + 1, 2),
    )))
    asked = spread.select("event_type", F.explode(wanted).alias("w")).select("event_type", "w.*")
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("c")).join(asked, "event_type")
    below = counts.where(F.col("value") < F.col("from")).groupBy("event_type", "name").agg(F.sum("c").alias("below"))
    inside = counts.where(F.col("value").between(F.col("from"), F.col("to"))).join(below, ["event_type", "name"], "left")
    upto = F.coalesce("below", F.lit(0)) + F.sum("c").over(Window.partitionBy("event_type", "name").orderBy("value"))
    found = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    return found.groupBy("event_type").agg(*(F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in ("p50", "p95", "p95_floor")))


@query("null_aware_totals", """SELECT o_custkey, CASE WHEN count(x) = count(*) THEN round(sum(x), 2) END AS total FROM (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS x FROM orders) GROUP BY 1""")
def null_aware_totals(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(F.count(x) == F.count("*"), F.round(F.sum(x), 2)).alias("total"))


_BLOCK = 1024


@query("ordered_digest", f"""WITH a AS (SELECT source, doc_id // {_BLOCK} AS b, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2), c AS (SELECT source, b // {_BLOCK} AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM a GROUP BY source, a.b // {_BLOCK})
SELECT source, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM c GROUP BY 1""")
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest tree in the order of doc_id: no task gathers more than a block of hashes."""
    h = table(spark, d, "documents").select("source", F.col("doc_id").alias("k"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    for last in (False, False, True):
        up = [] if last else [F.floor(F.col("k") / _BLOCK).alias("b")]
        h = h.groupBy("source", *up).agg(F.sha2(F.expr("listagg(h) within group (order by k)").cast("binary"), 256).alias("h")).withColumnsRenamed({"b": "k"})
    return h.select("source", F.col("h").alias("digest"))


@query("masked_digest", """WITH c AS (SELECT conv_id, turn, CAST('0x' || substr(sha256(turn || ':' || sha256(text)), 1, 15) AS BIGINT)::HUGEINT AS h FROM conversations), s AS (SELECT conv_id, sum(h) AS total, count(*) AS n FROM c GROUP BY 1)
SELECT conv_id, turn, sha256(n || ':' || turn || ':' || CAST(total - h AS VARCHAR)) AS fingerprint FROM c JOIN s USING (conv_id)""")
def masked_digest(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's fingerprint of its conversation with its own place masked.

    The conversation's fingerprint is a sum of hashes that bind every turn to its place, so masking one is a
    subtraction and no turn gathers the others.
    """
    c = table(spark, d, "conversations")
    bound = F.sha2(F.concat(F.col("turn").cast("string"), F.lit(":"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256)
    c = c.select("conv_id", "turn", F.conv(F.substring(bound, 1, 15), 16, 10).cast("decimal(28,0)").alias("h"))
    whole = c.groupBy("conv_id").agg(F.sum("h").alias("total"), F.count("*").alias("n"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("turn").cast("string"), (F.col("total") - F.col("h")).cast("string"))
    return c.join(whole, "conv_id").select("conv_id", "turn", F.sha2(text.cast("binary"), 256).alias("fingerprint"))


@query("nested_rows", """SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final FROM orders GROUP BY 1""")
def nested_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.concat_ws(",", F.transform(rows, lambda r: F.concat_ws(":", r["o_orderkey"].cast("string"), r["o_orderstatus"]))).alias("orders"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_final"))


@query("coverage_report", """SELECT d.source, count(*) AS total, count(l.doc_id) AS covered, count(*) - count(l.doc_id) AS missing, count(*) FILTER (WHERE l.toxic = 1) AS dead FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("has", F.lit(1))
    got = table(spark, d, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    return got.groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("covered"), (F.count("*") - F.count("has")).alias("missing"), F.count(F.when(F.col("toxic") == 1, 1)).alias("dead"))


@query("completeness_gate", """SELECT o_orderkey, count(DISTINCT l_linenumber) AS n_lines, coalesce(max(l_linenumber), 0) AS last_line, coalesce(count(DISTINCT l_linenumber) = max(l_linenumber), false) AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey", "left")
    n, last = F.countDistinct("l_linenumber"), F.max("l_linenumber")
    return got.groupBy("o_orderkey").agg(n.alias("n_lines"), F.coalesce(last, F.lit(0)).alias("last_line"), F.coalesce(n == last, F.lit(False)).alias("complete"))


@query("conflict_detection", """SELECT text_digest, n_sources FROM (SELECT md5(text) AS text_digest, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1) WHERE n_sources > 1""")
def conflict_detection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_digest")).agg(F.countDistinct("source").alias("n_sources")).where("n_sources > 1")


@query("workload_counters", """SELECT lang, count(*) AS calls, sum(length(text))::BIGINT AS characters, max(length(text)) AS longest FROM documents GROUP BY 1""")
def workload_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).cast("long").alias("longest"))


@query("conditional_rates", """SELECT d.lang, round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS good_rate, round(avg(CASE WHEN l.quality = 1 THEN l.toxic END), 6) AS toxic_rate, avg(l.quality) >= 0.8 AS passed FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return got.groupBy("lang").agg(F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("good_rate"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6).alias("toxic_rate"), (F.avg("quality") >= 0.8).alias("passed"))


@query("round_robin_sample", """SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) ORDER BY k, event_type LIMIT 42""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    # no type gives more than the limit, so ranks beyond it are cut where they are made
    return table(spark, d, "events").select("event_type", "event_id", k.alias("k")).where("k <= 42").orderBy("k", "event_type").limit(42).select("event_type", "event_id")


@query("inverted_index", """SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1""")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("types"))


@query("match_snippet", """SELECT doc_id, substr(text, greatest(1, pos - 40), 120) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'the') AS pos FROM documents) WHERE pos > 0""")
def match_snippet(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", "text", F.instr(F.lower("text"), "the").alias("at")).where("at > 0")
    return got.select("doc_id", F.expr("substring(text, greatest(1, at - 40), 120)").alias("snippet"))


@query("html_plain_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def html_plain_text(spark: SparkSession, d: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))
    return table(spark, d, "pages").select("page_id", F.md5(plain.cast("binary")).alias("digest"))


@query("interval_union", """WITH i AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate + INTERVAL 3 DAY AS DATE) AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM i)
SELECT l_suppkey, sum(greatest(0, b - greatest(a, coalesce(prior, a))))::BIGINT AS covered_days FROM m GROUP BY 1""")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), 3).alias("b"))
    return G.covered(i, "l_suppkey", "a", "b").withColumnRenamed("covered", "covered_days")


@query("export_manifest")
def workspace_export(spark: SparkSession, d: str) -> DataFrame:
    return export_manifest({"memories": V.memories(spark, d), "links": V.links(spark, d)})


# --- graphs


@query("link_degrees", f"""WITH l AS ({V.LINKS_SQL}) SELECT id, count(*) AS degree, sum(weight)::BIGINT AS weight FROM (SELECT source_id AS id, weight FROM l UNION ALL SELECT target_id, weight FROM l) GROUP BY 1""")
def link_degrees(spark: SparkSession, d: str) -> DataFrame:
    l = V.links(spark, d)
    return l.select(F.explode(F.array("source_id", "target_id")).alias("id"), "weight").groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


@query("graph_centrality", f"""WITH l AS ({V.LINKS_SQL}), e AS (SELECT source_id AS a, target_id AS b FROM l UNION SELECT target_id, source_id FROM l), n AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + 1000000000 FROM supplier),
g AS (SELECT n.id, count(DISTINCT e.b) AS degree FROM n LEFT JOIN e ON e.a = n.id GROUP BY 1), st AS (SELECT count(*) AS n, max(degree) AS top FROM g), md AS (SELECT degree AS median FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS k FROM g), st WHERE k = n // 2 + 1), r AS (SELECT g.*, row_number() OVER (ORDER BY degree DESC, id) AS k FROM g)
SELECT id, degree, round(CASE WHEN top > 0 THEN ln(1 + degree) / ln(1 + top) ELSE 0 END, 6) AS gravity, round(4 + least(12, 2.2 * log2(degree + 1)), 6) AS radius, degree >= greatest(3, 2 * median) AND k <= least(8, greatest(1, ceil(n * 0.008))) AS hub FROM r, st, md""")
def graph_centrality(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id")).union(table(spark, d, "supplier").select(F.col("s_suppkey") + F.lit(1_000_000_000)))
    return G.centrality(nodes, V.links(spark, d))


_STOPS = ", ".join(f"'{w}'" for w in G.STOP_WORDS)


@query("affinity_edges", rf"""WITH t AS (SELECT DISTINCT id, term FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9_-]{{1,63}})', 1)) AS term FROM documents) WHERE term NOT IN ({_STOPS}) QUALIFY dense_rank() OVER (ORDER BY id DESC) <= {G.NEWEST}), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1), i AS (SELECT a.id AS source, b.id AS target, count(*) AS c FROM t a JOIN t b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT source, target, round(c / sqrt(x.n * y.n), 4) AS weight FROM i JOIN n x ON x.id = source JOIN n y ON y.id = target WHERE c / sqrt(x.n * y.n) >= 0.16""")
def affinity_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.affinity(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("affinity_matching")
def affinity_matching(spark: SparkSession, d: str) -> DataFrame:
    """At most three affine neighbours for each of the benchmark's passages; tested against the sequential choice."""
    return G.capped(G.affinity(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))), 3)

"""Queries of the relational set: authorisation, filters, joins, paging, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import access
from ..sources import views as V
from ..sources.tables import table
from .registry import query

_ACTIVE = f"WITH m AS ({V.MEMORIES_SQL}), u AS (SELECT DISTINCT user_id, workspace_id FROM ({V.MEMBERSHIPS_SQL}) WHERE status = 'active')"


@query("visible_memories", f"""{_ACTIVE} SELECT u.user_id, m.id, m.scope FROM m JOIN u USING (workspace_id) WHERE m.scope = 'shared' OR m.owner_id = u.user_id""")
def visible_memories(spark: SparkSession, d: str) -> DataFrame:
    return access.visible(V.memories(spark, d).select("id", "workspace_id", "owner_id", "scope"), V.memberships(spark, d)).select("user_id", "id", "scope")


@query("writable_memories", f"""{_ACTIVE} SELECT u.user_id, count(*) AS n_writable FROM m JOIN u USING (workspace_id) WHERE m.owner_id = u.user_id GROUP BY 1""")
def writable_memories(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d).select("id", "workspace_id", "owner_id")
    return m.join(access.active_members(V.memberships(spark, d)), "workspace_id").where("owner_id = user_id").groupBy("user_id").agg(F.count("*").alias("n_writable"))


@query("agent_access", f"""SELECT a.agent_id, a.owner_id, g.workspace_id FROM ({V.AGENTS_SQL}) a JOIN ({V.GRANTS_SQL}) g USING (agent_id)
WHERE a.status = 'active' AND g.status = 'active' AND EXISTS (SELECT 1 FROM ({V.MEMBERSHIPS_SQL}) m WHERE m.user_id = a.owner_id AND m.workspace_id = g.workspace_id AND m.status = 'active')""")
def agent_access(spark: SparkSession, d: str) -> DataFrame:
    return access.agent_access(V.agents(spark, d), V.grants(spark, d), V.memberships(spark, d))


@query("agent_write_access", f"""SELECT g.workspace_id, count(DISTINCT a.agent_id) AS n_agents FROM ({V.AGENTS_SQL}) a JOIN ({V.GRANTS_SQL}) g USING (agent_id)
WHERE a.status = 'active' AND g.status = 'active' AND g.permission = 'write' AND EXISTS (SELECT 1 FROM ({V.MEMBERSHIPS_SQL}) m WHERE m.user_id = a.owner_id AND m.workspace_id = g.workspace_id AND m.status = 'active') GROUP BY 1""")
def agent_write_access(spark: SparkSession, d: str) -> DataFrame:
    return access.agent_access(V.agents(spark, d), V.grants(spark, d), V.memberships(spark, d), "write").groupBy("workspace_id").agg(F.countDistinct("agent_id").alias("n_agents"))


@query("my_workspaces", f"""SELECT u.user_id, r.r_name AS workspace, row_number() OVER (PARTITION BY u.user_id ORDER BY r.r_name, r.r_regionkey) AS position
FROM (SELECT DISTINCT user_id, workspace_id FROM ({V.MEMBERSHIPS_SQL}) WHERE status = 'active') u JOIN region r ON r.r_regionkey = u.workspace_id""")
def my_workspaces(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    got = access.active_members(V.memberships(spark, d)).join(r, F.col("workspace_id") == r.r_regionkey)
    return got.select("user_id", F.col("r_name").alias("workspace"), F.row_number().over(Window.partitionBy("user_id").orderBy("r_name", "r_regionkey")).cast("long").alias("position"))


@query("authenticate_credential", f"""SELECT a.agent_id, n.n_name AS owner, r.r_name AS workspace FROM ({V.AGENTS_SQL}) a JOIN ({V.GRANTS_SQL}) g USING (agent_id)
JOIN ({V.MEMBERSHIPS_SQL}) m ON m.user_id = a.owner_id AND m.workspace_id = g.workspace_id JOIN nation n ON n.n_nationkey = a.owner_id JOIN region r ON r.r_regionkey = g.workspace_id
WHERE a.status = 'active' AND g.status = 'active' AND m.status = 'active'""")
def authenticate_credential(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    got = access.agent_access(V.agents(spark, d), V.grants(spark, d), V.memberships(spark, d))
    return got.join(n, got.owner_id == n.n_nationkey).join(r, got.workspace_id == r.r_regionkey).select("agent_id", F.col("n_name").alias("owner"), F.col("r_name").alias("workspace"))


@query("disable_outcome", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM ({V.GRANTS_SQL}) g WHERE g.agent_id = a.agent_id AND g.status = 'active') THEN 'not_found'
WHEN a.status <> 'disabled' THEN 'still_active' ELSE 'deleted' END AS outcome FROM ({V.AGENTS_SQL}) a) GROUP BY 1""")
def disable_outcome(spark: SparkSession, d: str) -> DataFrame:
    granted = V.grants(spark, d).where("status = 'active'").select("agent_id").distinct().withColumn("granted", F.lit(True))
    got = V.agents(spark, d).join(granted, "agent_id", "left")
    return got.groupBy(F.when(F.col("granted").isNull(), "not_found").when(F.col("status") != "disabled", "still_active").otherwise("deleted").alias("outcome")).agg(F.count("*").alias("n"))


@query("visible_links", f"""WITH l AS ({V.LINKS_SQL}), n AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25 UNION ALL SELECT s_suppkey + 1000000000 FROM supplier WHERE s_acctbal > 0)
SELECT l.source_id, l.target_id, l.weight FROM l WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def visible_links(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    nodes = p.where("p_size <= 25").select(F.col("p_partkey").alias("id")).union(s.where("s_acctbal > 0").select(F.col("s_suppkey") + F.lit(1_000_000_000)))
    return access.with_both_ends(V.links(spark, d), nodes).select("source_id", "target_id", "weight")


# --- filters


@query("time_scope_filter", f"""SELECT id, scope, updated_at FROM ({V.MEMORIES_SQL}) WHERE scope = 'shared' AND updated_at >= TIMESTAMP '2024-01-01 02:00:00' AND updated_at < TIMESTAMP '2024-01-01 12:00:00' AND id NOT IN (130, 131, 200)""")
def time_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    excluded = spark.createDataFrame([(130,), (131,), (200,)], "id long")
    m = V.memories(spark, d).where("scope = 'shared' and updated_at >= timestamp_ntz'2024-01-01 02:00:00' and updated_at < timestamp_ntz'2024-01-01 12:00:00'")
    return m.join(excluded, "id", "left_anti").select("id", "scope", "updated_at")


@query("metadata_filter", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IN ('1', '3', '7')""")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(k.isin("1", "3", "7")).select("event_id", k.cast("long").alias("k"))


@query("metadata_containment", """SELECT event_type, count(*) AS n FROM events WHERE json_contains(props, '{"k": 5}') GROUP BY 1""")
def metadata_containment(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.json_tools import contains

    return table(spark, d, "events").where(contains("props", {"k": 5})).groupBy("event_type").agg(F.count("*").alias("n"))


@query("path_prefix_filter", """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE path = '/en' OR left(path, 4) = '/en/'""")
def path_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return p.where((F.col("path") == "/en") | F.col("path").startswith("/en/"))


@query("literal_substring", """SELECT p_partkey, instr(lower(p_name), lower('A')) AS at FROM part WHERE instr(lower(p_name), lower('A')) > 0""")
def literal_substring(spark: SparkSession, d: str) -> DataFrame:
    at = F.instr(F.lower("p_name"), "a")
    return table(spark, d, "part").where(at > 0).select("p_partkey", at.cast("long").alias("at"))


@query("suffix_match", """SELECT p_type, count(*) AS n FROM part WHERE ends_with(p_brand, '3') GROUP BY 1""")
def suffix_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_brand").endswith("3")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("content_validation", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN contains(text, chr(0)) THEN 'nul' WHEN length(text) > 32000 THEN 'too_long' WHEN length(text) > 8000 THEN 'long' ELSE 'ok' END AS verdict FROM documents) GROUP BY 1""")
def content_validation(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    verdict = F.when(F.trim(t) == "", "blank").when(F.instr(t, "\0") > 0, "nul").when(F.length(t) > 32000, "too_long").when(F.length(t) > 8000, "long").otherwise("ok")
    return table(spark, d, "documents").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("memory_previews", f"""SELECT id, CASE WHEN length(t) > 72 THEN rtrim(substr(t, 1, 71)) || '…' ELSE t END AS label FROM (SELECT id, trim(regexp_replace(content, '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM ({V.MEMORIES_SQL}))""")
def memory_previews(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace("content", r"[ \t\n\r]+", " "))
    return V.memories(spark, d).select("id", F.when(F.length(t) > 72, F.concat(F.rtrim(F.substring(t, 1, 71)), F.lit("…"))).otherwise(t).alias("label"))


@query("input_validators", r"""SELECT sum(CASE WHEN regexp_matches(url, '^https?://[a-z0-9.-]+(/|$)') THEN 1 ELSE 0 END)::BIGINT AS n_urls, sum(CASE WHEN length(url) BETWEEN 1 AND 2000 THEN 1 ELSE 0 END)::BIGINT AS n_bounded FROM pages""")
def input_validators(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").agg(F.sum(F.col("url").rlike(r"^https?://[a-z0-9.-]+(/|$)").cast("long")).alias("n_urls"), F.sum(F.length("url").between(1, 2000).cast("long")).alias("n_bounded"))


# --- paging and order


@query("keyset_page", f"""SELECT id, updated_at FROM ({V.MEMORIES_SQL}) WHERE updated_at < TIMESTAMP '2024-01-01 10:00:00' OR (updated_at = TIMESTAMP '2024-01-01 10:00:00' AND id > 600) ORDER BY updated_at DESC, id LIMIT 50""")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d).where("updated_at < timestamp_ntz'2024-01-01 10:00:00' or (updated_at = timestamp_ntz'2024-01-01 10:00:00' and id > 600)")
    return m.select("id", "updated_at").orderBy(F.desc("updated_at"), "id").limit(50)


@query("offset_page", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("truncated_listing", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE k <= 10) AS n_listed, bool_or(k > 10) AS truncated FROM r WHERE k <= 11 GROUP BY 1""")
def truncated_listing(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    r = table(spark, d, "orders").select("o_custkey", k.alias("k")).where("k <= 11")
    return r.groupBy("o_custkey").agg(F.count(F.when(F.col("k") <= 10, 1)).alias("n_listed"), F.bool_or(F.col("k") > 10).alias("truncated"))


@query("batch_lookup_in_order", """WITH q AS (SELECT o_orderkey AS request, unnest([o_custkey, o_custkey + 1, 1, 3]) AS id, generate_subscripts([o_custkey, o_custkey + 1, 1, 3], 1) AS position FROM orders)
SELECT q.request, q.position, c.c_custkey, c.c_name FROM q JOIN customer c ON c.c_custkey = q.id""")
def batch_lookup_in_order(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.lit(1).cast("long"), F.lit(3).cast("long"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.posexplode(ids).alias("at", "id"))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return q.join(c, F.col("id") == F.col("c_custkey")).select("request", (F.col("at") + 1).cast("long").alias("position"), "c_custkey", "c_name")


@query("inline_relation", """SELECT p.p_partkey, v.boost FROM (VALUES (1, 1.5), (2, 2.0), (7, 0.25)) v(part, boost) JOIN part p ON p.p_partkey = v.part""".replace("v.boost", "CAST(v.boost AS DOUBLE) AS boost"))
def inline_relation(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.json_tools import recordset

    rows = recordset(spark, '[{"part": 1, "boost": 1.5}, {"part": 2, "boost": 2.0}, {"part": 7, "boost": 0.25}]', "part long, boost double")
    return table(spark, d, "part").select("p_partkey").join(F.broadcast(rows), F.col("p_partkey") == F.col("part")).select("p_partkey", "boost")


@query("anchored_first", """SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag = 'R') DESC, l_orderkey, l_linenumber) AS position FROM lineitem""")
def anchored_first(spark: SparkSession, d: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(F.col("l_returnflag") == "R"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", at.cast("long").alias("position"))


@query("stratified_sample", """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 ORDER BY k, source LIMIT 60""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id", k.alias("k")).where("k <= 5").orderBy("k", "source").limit(60).select("source", "doc_id")


# --- joins and sets


@query("semi_join_access", """SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def semi_join_access(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_join_missing", """SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("band_join_neighbors", """SELECT a.conv_id, a.turn, count(*) AS n_neighbors, min(b.turn) AS first_turn, max(b.turn) AS last_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2""")
def band_join_neighbors(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.select("conv_id", "turn", F.count("*").over(w).alias("n_neighbors"), F.min("turn").over(w).alias("first_turn"), F.max("turn").over(w).alias("last_turn"))


@query("full_outer_diff", """WITH b AS (SELECT doc_id, quality FROM labels WHERE quality = 1 OR toxic = 1), a AS (SELECT doc_id, 1 - toxic AS quality FROM labels WHERE quality = 0 OR toxic = 1)
SELECT CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.quality <> b.quality THEN 'changed' ELSE 'same' END AS verdict, count(*) AS n FROM b FULL JOIN a ON a.doc_id = b.doc_id GROUP BY 1""")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "labels")
    before = l.where("quality = 1 or toxic = 1").select("doc_id", F.col("quality").alias("old"))
    after = l.where("quality = 0 or toxic = 1").select("doc_id", (1 - F.col("toxic")).alias("new"))
    verdict = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return before.join(after, "doc_id", "full").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("upsert_rearm", """WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority < '4'), new AS (SELECT o_orderkey AS id, 'P' AS status, o_totalprice * 2 AS price FROM orders WHERE o_orderpriority > '3')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.status WHEN n.id IS NOT NULL AND o.status = 'F' THEN n.status ELSE o.status END AS status, CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.status = 'F') THEN n.price ELSE o.price END AS price FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_rearm(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import upserted

    o = table(spark, d, "orders")
    old = o.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.where("o_orderpriority > '3'").select(F.col("o_orderkey").alias("id"), F.lit("P").alias("status"), (F.col("o_totalprice") * 2).alias("price"))
    return upserted(old, new, ["id"], when=F.col("old.status") == "F")


@query("insert_missing", """SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey >= 15""")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import appended

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return appended(n.where("id < 15"), n.where("id >= 10").withColumn("name", F.upper("name")), ["id"])


@query("unreferenced_payloads", """SELECT count(*) AS n_unreferenced FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')""")
def unreferenced_payloads(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").agg(F.count("*").alias("n_unreferenced"))


@query("five_table_edges", """SELECT r.r_name, s.s_name, p.p_brand, count(*) AS n, sum(l.l_quantity) AS quantity FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 25 LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2, 3""")
def five_table_edges(spark: SparkSession, d: str) -> DataFrame:
    l, s, p, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "part", "nation", "region"))
    got = l.join(s, l.l_suppkey == s.s_suppkey).join(p.where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left")
    got = got.join(n, got.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return got.groupBy("r_name", "s_name", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("active_generation", """WITH g AS (SELECT l_partkey, l_suppkey, max(l_shipdate) AS shipped FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY shipped DESC, l_suppkey) AS k FROM g)
SELECT p.p_partkey, x.l_suppkey, x.shipped FROM part p JOIN x ON x.l_partkey = p.p_partkey AND x.k = 1""")
def active_generation(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("shipped"))
    newest = l.groupBy("l_partkey").agg(F.max_by(F.struct("l_suppkey", "shipped"), F.struct("shipped", -F.col("l_suppkey"))).alias("x"))
    return table(spark, d, "part").select("p_partkey").join(newest, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "x.l_suppkey", "x.shipped")


@query("union_distinct_channels", """SELECT l_suppkey AS id FROM lineitem WHERE l_discount > 0.09 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""")
def union_distinct_channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_suppkey").alias("id")).union(table(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


@query("set_sizes", """SELECT a.user_id, len(list_intersect(a.t, b.t)) AS n_both, len(list_distinct(list_concat(a.t, b.t))) AS n_either FROM (SELECT user_id, list_distinct(list(event_type)) AS t FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1) a
JOIN (SELECT user_id, list_distinct(list(event_type)) AS t FROM events GROUP BY 1) b USING (user_id)""".replace("TIMESTAMP '2024-01-02'", "(SELECT min(ts) + INTERVAL 5 DAY FROM events)"))
def set_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = e.agg((F.min("ts") + F.expr("interval 5 days")).alias("until"))
    early = e.crossJoin(F.broadcast(first)).where("ts < until").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))  # one row
    every = e.groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    return early.join(every, "user_id").select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_either"))


@query("generated_graph", """SELECT (i % 5000) AS source_id, ((i * 7919 + 13) % 5000) AS target_id, count(*) AS weight FROM range(105000) t(i) GROUP BY 1, 2""")
def generated_graph(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return spark.range(105_000).groupBy((i % 5000).alias("source_id"), ((i * 7919 + 13) % 5000).alias("target_id")).agg(F.count("*").alias("weight"))

"""Queries of life cycles, guarded writes, portable archives, sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import access
from ..operators import lifecycle as L
from ..operators import ranking as R
from ..sources import views as V
from ..sources.sinks import upserted
from ..sources.tables import table
from .registry import query

_NOW = "(SELECT max(ts) FROM events)"
_JOBS = f"""SELECT event_id AS job_id, user_id, ts AS finished_at, CASE event_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'dead' WHEN 2 THEN 'pending' WHEN 3 THEN 'leased' ELSE 'cancelled' END AS status, value > 60 AS stale, {_NOW} AS now FROM events"""


def _shared(spark: SparkSession, name: str) -> str:
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-gleaner-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    status = F.when(k == 0, "succeeded").when(k == 1, "dead").when(k == 2, "pending").when(k == 3, "leased").otherwise("cancelled")
    now = e.agg(F.max("ts").alias("now"))  # one row
    return e.select(F.col("event_id").alias("job_id"), "user_id", F.col("ts").alias("finished_at"), status.alias("status"), (F.col("value") > 60).alias("stale")).crossJoin(F.broadcast(now))


@query("stale_sweep", f"""WITH j AS ({_JOBS}) SELECT CASE WHEN status IN ('succeeded', 'cancelled') AND finished_at < now - INTERVAL 7 DAY THEN 'delete' WHEN status = 'dead' AND finished_at < now - INTERVAL 30 DAY THEN 'delete' WHEN status = 'pending' AND stale THEN 'cancel' WHEN status = 'leased' AND stale THEN 'bury' ELSE 'keep' END AS action, status, count(*) AS n FROM j GROUP BY 1, 2""")
def stale_sweep(spark: SparkSession, d: str) -> DataFrame:
    return L.swept(_jobs(spark, d), F.col("now"), F.col("stale")).groupBy("action", "status").agg(F.count("*").alias("n"))


@query("seeded_jobs", """SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def seeded_jobs(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    covered = table(spark, d, "events").where("event_type = 'click'")
    return L.missing_coverage(items, covered, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("pending_jobs", f"""WITH j AS ({_JOBS}) SELECT j.job_id, u.c_name AS requester, row_number() OVER (ORDER BY finished_at, job_id) AS position FROM j JOIN customer u ON u.c_custkey = j.user_id WHERE status = 'pending' AND finished_at >= now - INTERVAL 3 DAY""")
def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the last three days that wait, in their order."""
    j = _jobs(spark, d).where("status = 'pending' and finished_at >= now - interval 3 days")
    got = j.join(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("requester")), "user_id")
    return R.placed(got, F.col("finished_at"), F.col("job_id"), name="position").select("job_id", "requester", "position")


_GENERATIONS = """SELECT d.source AS workspace, CASE d.lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS generation_id, count(l.doc_id) AS covered, count(*) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1, 2"""


@query("generation_lifecycle", f"""WITH g AS ({_GENERATIONS}), r AS (SELECT *, covered >= 0.4 * total AS ready FROM g), n AS (SELECT *, max(CASE WHEN ready THEN generation_id END) OVER (PARTITION BY workspace) AS newest FROM r)
SELECT workspace, CAST(generation_id AS INTEGER) AS generation_id, covered, total, CASE WHEN NOT ready THEN 'building' WHEN generation_id = newest THEN 'active' ELSE 'retiring' END AS state FROM n""")
def generation_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    g = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    got = table(spark, d, "documents").select("doc_id", F.col("source").alias("workspace"), g.alias("generation_id")).join(labelled, "doc_id", "left")
    counts = got.groupBy("workspace", "generation_id").agg(F.count("has").alias("covered"), F.count("*").alias("total"))
    return L.generation_states(counts, "workspace", 0.4)


@query("retention_prune", """WITH g AS (SELECT o_orderkey AS generation_id, CASE o_orderstatus WHEN 'F' THEN 'retiring' WHEN 'O' THEN 'active' ELSE 'building' END AS state, o_orderdate AS ended_at FROM orders), n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT generation_id FROM g, n WHERE state = 'retiring' AND ended_at <= now - INTERVAL 7 DAY AND generation_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def retention_prune(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "retiring").when(F.col("o_orderstatus") == "O", "active").otherwise("building")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    g = o.select(F.col("o_orderkey").alias("generation_id"), state.alias("state"), F.col("o_orderdate").alias("ended_at")).crossJoin(F.broadcast(now))
    return L.prunable(g, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("generation_id")), F.col("now")).select("generation_id")


@query("version_guard", """WITH m AS (SELECT doc_id AS id, doc_id % 3 + 1 AS version FROM documents), q AS (SELECT event_id AS request_id, event_id % 1200 AS id, event_id % 2 + 1 AS expected FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY id, expected ORDER BY request_id) AS k FROM q)
SELECT request_id, k.id, CASE WHEN m.version IS NULL THEN 'not_found' WHEN m.version = expected AND k = 1 THEN 'updated' ELSE 'conflict' END AS outcome, CASE WHEN m.version = expected AND k = 1 THEN m.version + 1 ELSE m.version END AS version FROM k LEFT JOIN m ON m.id = k.id""")
def version_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3 + 1).alias("version"))
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 1200).alias("id"), (F.col("event_id") % 2 + 1).alias("expected"))
    return L.guarded_update(rows, asked, "id")


@query("link_outbox", """WITH b AS (SELECT l_partkey AS source_id, l_suppkey AS target_id, min(l_linestatus) AS kind, count(*) AS weight FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1, 2), a AS (SELECT l_partkey AS source_id, l_suppkey AS target_id, min(l_linestatus) AS kind, count(*) AS weight FROM lineitem WHERE l_shipdate > TIMESTAMP '1993-06-01' GROUP BY 1, 2)
SELECT source_id, target_id, CASE WHEN b.weight IS NULL THEN 'created' WHEN a.weight IS NULL THEN 'deleted' ELSE 'updated' END AS event_type, CASE WHEN b.weight IS NULL OR a.weight IS NULL THEN 'kind,weight' ELSE concat_ws(',', CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.weight <> b.weight THEN 'weight' END) END AS changed_fields
FROM b FULL JOIN a USING (source_id, target_id) WHERE b.kind IS DISTINCT FROM a.kind OR b.weight IS DISTINCT FROM a.weight""")
def link_outbox(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import field_changes

    l = table(spark, d, "lineitem")
    links = lambda rows: rows.groupBy(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).agg(F.min("l_linestatus").alias("kind"), F.count("*").alias("weight"))
    return field_changes(links(l.where("l_shipdate < timestamp_ntz'1996-06-01'")), links(l.where("l_shipdate > timestamp_ntz'1993-06-01'")), ["source_id", "target_id"])


@query("job_lifecycle", """WITH t AS (SELECT user_id AS job_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events)
SELECT job_id, count(*) AS n_transitions, count(*) FILTER (WHERE event_type = 'click') AS n_claims, max(last) AS state FROM t GROUP BY 1""")
def job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.count("*").alias("n_transitions"), F.count_if(F.col("event_type") == "click").alias("n_claims"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("replay_scrub", """SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""")
def replay_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Replay rows whose answer names a deleted resource go."""
    gone = table(spark, d, "labels").where("toxic = 1 and doc_id is not null").select(F.col("doc_id").alias("k")).distinct()
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")
    return e.join(gone, "k", "left_anti").select("event_id")


@query("content_sets", """WITH s AS (SELECT l_orderkey, sha256(string_agg(k, chr(10) ORDER BY k)) AS digest FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS k FROM lineitem) GROUP BY 1), known AS (SELECT DISTINCT digest FROM s WHERE l_orderkey % 2 = 0)
SELECT digest, count(*) AS n_members, digest NOT IN (SELECT digest FROM known) AS added FROM s GROUP BY 1""")
def content_sets(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    known = L.stored_sets(l.where("l_orderkey % 2 = 0"), "l_orderkey", "l_suppkey", l.sparkSession.createDataFrame([], "digest string"))[1]
    sets, added = L.stored_sets(l, "l_orderkey", "l_suppkey", known)
    return sets.groupBy("digest").agg(F.count("*").alias("n_members")).join(added.withColumn("added", F.lit(True)), "digest", "left").fillna(False, ["added"])


def _imports(policy: str, clash: str) -> str:
    return f"""WITH e AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0), a AS (SELECT doc_id AS id, doc_id % 25 AS owner_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS content FROM documents), o AS (SELECT CAST(n_nationkey AS BIGINT) AS owner_id, CAST(n_nationkey + 100 AS BIGINT) AS new_owner_id FROM nation WHERE n_nationkey % 7 <> 3), t AS (SELECT max(id) AS top FROM a),
r AS (SELECT a.id, o.new_owner_id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'invalid' WHEN new_owner_id IS NULL THEN 'unmapped' WHEN e.id IS NOT NULL THEN '{clash}' ELSE 'imported' END AS outcome FROM a LEFT JOIN e USING (id) LEFT JOIN o USING (owner_id))
SELECT r.id, CASE outcome WHEN 'remapped' THEN top + 1 + r.id WHEN 'imported' THEN r.id END AS new_id, new_owner_id AS owner_id, outcome FROM r, t"""


def _import(policy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents")
        archive = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias("owner_id"), F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("text")).alias("content"))
        where = _shared(spark, "archive")
        archive.write.json(where)  # the archive travels as JSON lines
        read = spark.read.schema(archive.schema).json(where)
        owners = table(spark, d, "nation").where("n_nationkey % 7 <> 3").select(F.col("n_nationkey").cast("long").alias("owner_id"), (F.col("n_nationkey") + 100).cast("long").alias("new_owner_id"))
        return L.import_outcomes(read, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")), owners, policy)

    return run


for _policy, _clash in (("error", "error"), ("skip", "skipped"), ("remap", "remapped")):
    query(f"workspace_import_{_policy}", _imports(_policy, _clash))(_import(_policy))


@query("json_lines_source", """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_lines_source(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read back with their nested properties."""
    where = _shared(spark, "lines")
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    e.write.json(where)
    return spark.read.schema(e.schema).json(where).select("event_id", "event_type", "props.k")


@query("json_array_source", """SELECT n_nationkey, n_name FROM nation""")
def json_array_source(spark: SparkSession, d: str) -> DataFrame:
    """A file that holds one JSON array, a row an element; like every such file it is read by one task."""
    where = _shared(spark, "array")
    one = table(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.coalesce(1).write.text(where)
    return spark.read.schema("n_nationkey int, n_name string").option("multiLine", True).json(where)


@query("derived_rows_replaced", """SELECT source, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents WHERE NOT (source IN (SELECT max(source) FROM documents) AND length(text) % 2 = 1) GROUP BY 1""")
def derived_rows_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table partitioned by source; one source's rows are derived anew and only its partition is overwritten."""
    from ..sources.sinks import replaced

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    where = _shared(spark, "derived")
    docs.write.partitionBy("source").parquet(where)
    last = docs.agg(F.max("source").alias("source"))  # one row
    replaced(docs.join(F.broadcast(last), "source").where("length(text) % 2 = 0").select("doc_id", "text", "source"), where, "source")
    return spark.read.schema("doc_id long, text string, source string").parquet(where).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


# --- tenancy and administration


@query("point_lookup", f"SELECT id, workspace_id, owner_id, scope FROM ({V.MEMORIES_SQL}) WHERE id = (SELECT max(doc_id) FROM documents)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "documents").agg(F.max("doc_id").alias("id"))  # one row
    return V.memories(spark, d).join(F.broadcast(last), "id", "left_semi").select("id", "workspace_id", "owner_id", "scope")


@query("own_agents", f"""SELECT a.owner_id, g.workspace_id, a.agent_id, row_number() OVER (PARTITION BY a.owner_id, g.workspace_id ORDER BY a.agent_id DESC) AS position FROM ({V.AGENTS_SQL}) a JOIN ({V.GRANTS_SQL}) g USING (agent_id)""")
def own_agents(spark: SparkSession, d: str) -> DataFrame:
    got = V.agents(spark, d).select("agent_id", "owner_id").join(V.grants(spark, d).select("agent_id", "workspace_id"), "agent_id")
    return got.withColumn("position", F.row_number().over(Window.partitionBy("owner_id", "workspace_id").orderBy(F.desc("agent_id"))).cast("long"))


@query("visible_credentials", f"""SELECT c_custkey AS credential_id, ps.agent_id FROM (SELECT c_custkey, c_custkey % 10 + 1 AS agent_id FROM customer WHERE c_acctbal > 0) ps WHERE EXISTS (SELECT 1 FROM ({V.GRANTS_SQL}) g WHERE g.agent_id = ps.agent_id AND g.status = 'active')""")
def visible_credentials(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("credential_id"), (F.col("c_custkey") % 10 + 1).alias("agent_id"))
    return c.join(V.grants(spark, d).where("status = 'active'").select("agent_id"), "agent_id", "left_semi").select("credential_id", "agent_id")


@query("resolved_identity", """SELECT c.c_custkey AS identity, CAST(n.n_nationkey AS BIGINT) AS user_id FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def resolved_identity(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("identity"), F.col("n_nationkey").cast("long").alias("user_id"))


@query("membership_reactivated", f"""WITH m AS ({V.MEMBERSHIPS_SQL}), i AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS workspace_id FROM nation UNION SELECT user_id, workspace_id FROM m WHERE user_id % 2 = 0)
SELECT coalesce(m.user_id, i.user_id) AS user_id, coalesce(m.workspace_id, i.workspace_id) AS workspace_id, CASE WHEN i.user_id IS NOT NULL THEN 'active' ELSE m.status END AS status FROM m FULL JOIN i ON m.user_id = i.user_id AND m.workspace_id = i.workspace_id""")
def membership_reactivated(spark: SparkSession, d: str) -> DataFrame:
    """Invitations add memberships or bring back those that were left."""
    m = V.memberships(spark, d)
    invited = m.select("user_id", F.lit(0).cast("long").alias("workspace_id")).union(m.where("user_id % 2 = 0").select("user_id", "workspace_id")).distinct().withColumn("status", F.lit("active"))
    return upserted(m, invited, ["user_id", "workspace_id"], F.col("old.status") != "active")


@query("credential_revocation", f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN a.agent_id IS NULL THEN 'not_found' WHEN c_acctbal <= 0 THEN 'already_revoked' ELSE 'revoked' END AS outcome FROM customer LEFT JOIN ({V.AGENTS_SQL}) a ON a.agent_id = c_custkey % 13 AND a.status = 'active') GROUP BY 1""")
def credential_revocation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select((F.col("c_custkey") % 13).alias("agent_id"), "c_acctbal")
    a = V.agents(spark, d).where("status = 'active'").select("agent_id", F.lit(True).alias("found"))
    return c.join(a, "agent_id", "left").groupBy(F.when(F.col("found").isNull(), "not_found").when(F.col("c_acctbal") <= 0, "already_revoked").otherwise("revoked").alias("outcome")).agg(F.count("*").alias("n"))


@query("workspace_rights", f"""SELECT user_id, workspace_id, active AND role = 'owner' AS manages, active AND role IN ('owner', 'admin') AS evaluates, active AND role <> 'guest' AS reviews, active AS reads_code, active AND role <> 'guest' AS writes_code FROM (SELECT user_id, workspace_id, status = 'active' AS active, CASE user_id % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'member' ELSE 'guest' END AS role FROM ({V.MEMBERSHIPS_SQL}))""")
def workspace_rights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 4
    m = V.memberships(spark, d).withColumn("role", F.when(k == 0, "owner").when(k == 1, "admin").when(k == 2, "member").otherwise("guest"))
    return access.rights(m).select("user_id", "workspace_id", "manages", "evaluates", "reviews", "reads_code", "writes_code")


@query("capabilities_document", f"""WITH g AS ({_GENERATIONS}), b AS (SELECT workspace, max(generation_id) AS generation, sum(covered)::BIGINT AS covered FROM g GROUP BY 1) SELECT workspace, '{{"search":{{"channels":["simple","relaxed","cjk","semantic"],"maxResults":100}},"generation":' || generation || ',"covered":' || covered || '}}' AS document FROM b""")
def capabilities_document(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    g = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    b = table(spark, d, "documents").select("doc_id", F.col("source").alias("workspace"), g.alias("g")).join(labelled, "doc_id", "left").groupBy("workspace").agg(F.max("g").alias("generation"), F.count("has").alias("covered"))
    search = F.struct(F.array(*map(F.lit, ("simple", "relaxed", "cjk", "semantic"))).alias("channels"), F.lit(100).alias("maxResults"))
    return b.select("workspace", F.to_json(F.struct(search.alias("search"), "generation", "covered")).alias("document"))


@query("artifact_listing", """SELECT p_brand AS revision, p_partkey AS artifact_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS position FROM part""")
def artifact_listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("revision"), F.col("p_partkey").alias("artifact_id"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", "p_partkey")).cast("long").alias("position"))


@query("best_symbol", """SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 10 DESC, p_retailprice, p_partkey) AS k FROM part) WHERE k = 1""")
def best_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The exact match of each artifact, else the first by ordinal: a grouped minimum, no sort of the group."""
    best = F.min(F.struct((F.col("p_size") != 10).alias("inexact"), "p_retailprice", "p_partkey"))["p_partkey"]
    return table(spark, d, "part").groupBy("p_brand").agg(best.alias("p_partkey"))


@query("payload_join", """WITH p AS (SELECT md5(text) AS digest, min(doc_id) AS payload_id, min(source) AS source FROM documents GROUP BY 1) SELECT d.doc_id AS artifact_id, p.payload_id FROM documents d JOIN p ON p.digest = md5(d.text) AND p.source = d.source AND p.payload_id <= d.doc_id""")
def payload_join(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts with their stored payload; the digest is checked in the join."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    p = docs.groupBy("digest").agg(F.min("doc_id").alias("payload_id"), F.min("source").alias("source"))
    return docs.join(p, ["digest", "source"]).where("payload_id <= doc_id").select(F.col("doc_id").alias("artifact_id"), "payload_id")


@query("active_embeddings", f"""WITH g AS ({_GENERATIONS}), m AS (SELECT doc_id AS id, source AS workspace, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS generation_id FROM documents), a AS (SELECT workspace, max(generation_id) AS generation_id FROM g WHERE covered >= 0.4 * total GROUP BY 1)
SELECT e.vec_id, m.workspace, m.generation_id FROM embeddings e JOIN m ON m.id = e.vec_id JOIN a ON a.workspace = m.workspace AND a.generation_id = m.generation_id""")
def active_embeddings(spark: SparkSession, d: str) -> DataFrame:
    active = generation_lifecycle(spark, d).where("state = 'active'").select("workspace", "generation_id")
    g = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4)
    m = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("workspace"), g.alias("generation_id"))
    return table(spark, d, "embeddings").select("vec_id").join(m, "vec_id").join(active, ["workspace", "generation_id"]).select("vec_id", "workspace", "generation_id")


# --- episodes, policies, chunks


@query("evidence_groups", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, max(CASE WHEN k = 1 THEN role END) AS first_role, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE k <= 3)) AS digest, max(length(text)) AS longest FROM k GROUP BY 1""")
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's first role, its first three texts and its highest score."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("k", k)
    few = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("turn", "text"))))
    got = c.groupBy("conv_id").agg(F.max(F.when(F.col("k") == 1, F.col("role"))).alias("first_role"), few.alias("t"), F.max(F.length("text")).cast("long").alias("longest"))
    return got.select("conv_id", "first_role", F.md5(F.concat_ws("\n", F.transform("t", lambda x: x["text"])).cast("binary")).alias("digest"), "longest")


@query("policy_rates", """SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS passed_rate, round(avg(CASE WHEN user_id % 2 = 0 THEN CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END END), 6) AS invoked_rate, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def policy_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.when(c, 1.0).otherwise(0.0)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(rate(F.col("value") > 50)), 6).alias("passed_rate"), F.round(F.avg(F.when(F.col("user_id") % 2 == 0, rate(F.col("value") > 30))), 6).alias("invoked_rate"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("packed_episodes", """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), f AS (SELECT conv_id, turn, k, 0 AS bin, 1 AS n, size AS total FROM s WHERE k = 1
UNION ALL SELECT s.conv_id, s.turn, s.k, CASE WHEN f.n + 1 > 3 OR f.total + s.size > 600 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.n + 1 > 3 OR f.total + s.size > 600 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 3 OR f.total + s.size > 600 THEN s.size ELSE f.total + s.size END FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1) SELECT conv_id, turn, CAST(bin AS INTEGER) AS bin FROM f""")
def packed_episodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return L.packed(c, "conv_id", "turn", "size", 3, 600).select("conv_id", "turn", "bin")


@query("line_numbers", """SELECT doc_id, pos AS position, length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1 AS line FROM (SELECT doc_id, text, length(text) // 2 AS pos FROM documents) WHERE pos > 0""")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import line_at

    docs = table(spark, d, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).alias("position")).where("position > 0")
    return docs.select("doc_id", "position", line_at(F.col("text"), F.col("position")).cast("long").alias("line"))


@query("declaration_keys", """SELECT p_partkey, p_brand || ':' || p_type || CASE WHEN k > 1 THEN '~' || k ELSE '' END AS declaration_key FROM (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part)""")
def declaration_keys(spark: SparkSession, d: str) -> DataFrame:
    """Declarations keyed by name, repeated ones numbered."""
    k = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(":"), "p_type", F.when(k > 1, F.concat(F.lit("~"), k.cast("string"))).otherwise("")).alias("declaration_key"))


@query("blob_reuse", """WITH b AS (SELECT md5(text) AS digest, doc_id, source FROM documents) SELECT a.doc_id, max(b.doc_id) AS reused_from FROM b a JOIN b ON b.digest = a.digest AND b.doc_id < a.doc_id GROUP BY 1""")
def blob_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The newest earlier blob of the same content: the row before in each digest's order."""
    b = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return b.withColumn("reused_from", F.lag("doc_id").over(Window.partitionBy("digest").orderBy("doc_id"))).where("reused_from is not null").select("doc_id", "reused_from")


@query("blob_manifest", """SELECT outcome, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT strlen(text) AS size, CASE WHEN text = '' THEN 'excluded:empty' WHEN contains(text, chr(0)) THEN 'excluded:binary' WHEN strlen(text) > 20000 THEN 'excluded:oversized' WHEN lang = 'es' THEN 'excluded:unsupported' ELSE 'indexed' END AS outcome FROM documents) GROUP BY 1""")
def blob_manifest(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import blob_outcome

    docs = table(spark, d, "documents")
    got = docs.select(F.octet_length("text").alias("size"), blob_outcome(F.col("text").cast("binary"), 20_000, F.col("lang") != "es").alias("outcome"))
    return got.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("fallback_split", """SELECT doc_id, md5(text) AS digest, true AS bounded FROM documents WHERE text <> ''""")
def fallback_split(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.chunking import split_at_lines

    c = split_at_lines(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 6000)
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk")))
    return c.groupBy("doc_id").agg(F.md5(F.concat_ws("", F.transform(parts, lambda p: p["chunk"])).cast("binary")).alias("digest"), (F.max(F.length("chunk")) <= 6000).alias("bounded"))


@query("reference_resolution", """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.reference')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), CAST(event_id AS VARCHAR)) AS reference FROM events""")
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A configured reference, else a legacy one, else the id."""
    at = lambda p: F.nullif(F.trim(F.get_json_object("props", p)), F.lit(""))
    return table(spark, d, "events").select("event_id", F.coalesce(at("$.reference"), at("$.k"), F.col("event_id").cast("string")).alias("reference"))


@query("tone_counts", f"""WITH j AS ({_JOBS}) SELECT CASE WHEN status = 'succeeded' THEN 'good' WHEN status IN ('pending', 'leased') THEN 'busy' WHEN status = 'dead' THEN 'bad' ELSE 'muted' END AS tone, count(*) AS n FROM j GROUP BY 1""")
def tone_counts(spark: SparkSession, d: str) -> DataFrame:
    tone = F.when(F.col("status") == "succeeded", "good").when(F.col("status").isin("pending", "leased"), "busy").when(F.col("status") == "dead", "bad").otherwise("muted")
    return _jobs(spark, d).groupBy(tone.alias("tone")).agg(F.count("*").alias("n"))

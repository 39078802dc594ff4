"""State: outbox differences, leases, retries, expiry, idempotent replay, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import runs
from .registry import query

_NOW = "(SELECT max(ts) FROM events)"


@query("outbox_diff", """WITH b AS (SELECT l_orderkey, l_linenumber, sha256(l_returnflag) AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01'), a AS (SELECT l_orderkey, l_linenumber, sha256(CASE WHEN l_tax > 0.05 THEN upper(l_linestatus) ELSE l_returnflag END) AS h FROM lineitem WHERE l_shipdate > TIMESTAMP '1994-06-01')
SELECT CASE WHEN b.h IS NULL THEN 'created' WHEN a.h IS NULL THEN 'deleted' ELSE 'updated' END AS event_type, count(*) AS n FROM b FULL JOIN a USING (l_orderkey, l_linenumber) WHERE b.h IS DISTINCT FROM a.h GROUP BY 1""")
def outbox_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import change_feed

    l = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    before = l.where("l_shipdate < timestamp_ntz'1996-06-01'").select(*key, F.col("l_returnflag").alias("content"))
    after = l.where("l_shipdate > timestamp_ntz'1994-06-01'").select(*key, F.when(F.col("l_tax") > 0.05, F.upper("l_linestatus")).otherwise(F.col("l_returnflag")).alias("content"))
    return change_feed(before, after, key).groupBy("event_type").agg(F.count("*").alias("n"))


@query("lease_claim", f"""WITH j AS (SELECT user_id AS lane, event_id, ts AS available_at, CASE WHEN ts < {_NOW} - INTERVAL 20 DAY THEN 'stale' ELSE 'pending' END AS status FROM events WHERE event_type <> 'view'), k AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY available_at, event_id) AS k FROM j WHERE status = 'pending')
SELECT lane, event_id, available_at, 1 AS attempt FROM k WHERE k = 1""")
def lease_claim(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import claimed

    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    jobs = e.where("event_type <> 'view'").crossJoin(F.broadcast(now)).where("ts >= now - interval 20 days").select(F.col("user_id").alias("lane"), "event_id", F.col("ts").alias("available_at"), F.lit(0).alias("attempt"))
    return claimed(jobs, "lane", ["available_at", "event_id"])


@query("job_outcomes", """WITH j AS (SELECT event_id, user_id, 1 + event_id % 8 AS attempt, value FROM events) SELECT outcome, count(*) AS n, sum(delay)::BIGINT AS delay FROM (SELECT CASE WHEN value > 50 THEN 'succeeded' WHEN attempt >= 8 THEN 'dead' ELSE 'pending' END AS outcome, CASE WHEN value > 50 OR attempt >= 8 THEN 0 ELSE least(3600, 30 * pow(2, attempt - 1)) END AS delay FROM j) GROUP BY 1""")
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import backoff_seconds

    attempt = (1 + F.col("event_id") % 8).cast("int")
    outcome = F.when(F.col("value") > 50, "succeeded").when(attempt >= 8, "dead").otherwise("pending")
    got = table(spark, d, "events").select(outcome.alias("outcome"), F.when(outcome == "pending", backoff_seconds(attempt)).otherwise(0).alias("delay"))
    return got.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("delay").cast("long").alias("delay"))


@query("backoff_schedule", "SELECT DISTINCT event_id % 12 + 1 AS attempt, CAST(least(3600, 30 * pow(2, event_id % 12)) AS BIGINT) AS seconds FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.changes import backoff_seconds

    attempts = table(spark, d, "events").select((F.col("event_id") % 12 + 1).alias("attempt")).distinct()
    return attempts.select("attempt", backoff_seconds(F.col("attempt")).cast("long").alias("seconds"))


@query("ttl_purge", f"""SELECT event_type, count(*) AS n_kept, min(ts) AS oldest FROM events WHERE ts >= {_NOW} - CASE event_type WHEN 'click' THEN INTERVAL 10 DAY WHEN 'view' THEN INTERVAL 5 DAY ELSE INTERVAL 20 DAY END GROUP BY 1""")
def ttl_purge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    days = F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 5).otherwise(20)
    kept = e.crossJoin(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.make_dt_interval(days=days))
    return kept.groupBy("event_type").agg(F.count("*").alias("n_kept"), F.min("ts").alias("oldest"))


@query("idempotent_dedupe", """SELECT user_id, event_type, event_id, n_replays, n_conflicts FROM (SELECT user_id, event_type, event_id, row_number() OVER w AS k, count(*) OVER p - 1 AS n_replays, sum(CASE WHEN props <> first THEN 1 ELSE 0 END) OVER p AS n_conflicts FROM (SELECT *, first_value(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first FROM events) WINDOW p AS (PARTITION BY user_id, event_type), w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE k = 1""".replace("sum(CASE WHEN props <> first THEN 1 ELSE 0 END) OVER p", "(sum(CASE WHEN props <> first THEN 1 ELSE 0 END) OVER p)::BIGINT"))
def idempotent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first request of each key answers the others: replays with the same body, conflicts with another."""
    e = table(spark, d, "events")
    key = ["user_id", "event_type"]
    first = e.groupBy(*key).agg(F.min_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("f"), F.count("*").alias("n"))
    bad = e.join(first, key).groupBy(*key).agg(F.count(F.when(F.col("props") != F.col("f.props"), 1)).alias("n_conflicts"))
    return first.join(bad, key).select(*key, "f.event_id", (F.col("n") - 1).alias("n_replays"), "n_conflicts")


@query("session_gaps", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    s = table(spark, d, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("stream_daily_counts", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return runs.daily_counts(spark, d)


@query("stream_first_requests", """SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2""")
def stream_first_requests(spark: SparkSession, d: str) -> DataFrame:
    return runs.first_requests(spark, d)


@query("stream_proposals", """WITH RECURSIVE r AS (SELECT user_id % 6 AS owner, event_id, epoch_us(ts) AS at_us, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'propose' END AS action, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS memory, event_id % 17 = 0 AS by_agent,
row_number() OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id) AS i FROM events),
s(owner, i, event_id, number, outcome, n, live, vers) AS (
SELECT DISTINCT owner, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, []::STRUCT(number BIGINT, status VARCHAR, base BIGINT, memory BIGINT, expires BIGINT)[], [1, 1, 1, 1, 1, 1, 1]::BIGINT[] FROM r
UNION ALL
SELECT owner, i, event_id, number, outcome, n,
CASE WHEN outcome = 'pending' THEN list_append(live, {'number': number, 'status': 'pending', 'base': vers[memory + 1], 'memory': memory, 'expires': at_us + 604800000000}) WHEN outcome IN ('accepted', 'rejected') THEN list_append(list_filter(live, lambda x: x.number <> number), {'number': number, 'status': outcome, 'base': p.base, 'memory': p.memory, 'expires': at_us + 2592000000000}) ELSE live END,
CASE WHEN outcome = 'accepted' AND p.memory IS NOT NULL THEN list_transform(vers, lambda v, j: CASE WHEN j = p.memory + 1 THEN v + 1 ELSE v END) ELSE vers END
FROM (SELECT *, CASE WHEN action = 'propose' THEN CASE WHEN k % 60 > 50 THEN 'invalid' WHEN len(list_filter(live, lambda x: x.status = 'pending')) >= 100 THEN 'full' ELSE 'pending' END
WHEN by_agent THEN 'forbidden' WHEN p IS NULL THEN 'unknown' WHEN p.status <> 'pending' THEN CASE WHEN p.status = action THEN 'repeated' ELSE 'conflict' END WHEN action = 'accepted' AND p.memory IS NOT NULL AND vers[p.memory + 1] <> p.base THEN 'stale' ELSE action END AS outcome
FROM (SELECT *, list_filter(live, lambda x: x.number = number)[1] AS p FROM (SELECT r.owner, r.i, r.event_id, r.at_us, r.action, r.k, r.memory, r.by_agent, s.n + (r.action = 'propose')::BIGINT AS n, s.n + CASE WHEN r.action = 'propose' THEN 1 ELSE -(r.k % 40) END AS number, list_filter(s.live, lambda x: x.expires > r.at_us) AS live, s.vers FROM s JOIN r ON r.owner = s.owner AND r.i = s.i + 1))))
SELECT owner, event_id, number, outcome FROM s WHERE i > 0""")
def stream_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals and reviews as keyed state of a stream: limit of pending ones, expiry, version-bound idempotent review."""
    return runs.reviewed_proposals(spark, d)

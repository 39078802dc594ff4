"""Keyed stream state over several batches and a restart, set-returning functions, positional postings by hand."""

import random
import shutil
import tempfile
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.functions import table_functions
from gleaner.operators import positions as P
from gleaner.streaming import runs

from gleaner.plans.catalog import ORACLE_SQL

DAY = 86_400_000_000


def one_by_one(events, capacity, days):
    """Outcomes of the requests by walking each owner's in order of time."""
    n, live, versions, out = defaultdict(int), defaultdict(dict), defaultdict(lambda: 1), {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        owner, now, k = e["user_id"] % 6, e["us"], e["k"]
        mine = live[owner] = {i: p for i, p in live[owner].items() if p["until"] > now}
        memory = (owner, e["event_id"] % 7) if e["event_id"] % 3 == 0 else None
        if e["event_type"] not in ("view", "error"):
            n[owner] += 1
            number = n[owner]
            full = sum(p["status"] == "pending" for p in mine.values()) >= capacity
            outcome = "invalid" if k % 60 > 50 else "full" if full else "pending"
            if outcome == "pending":
                mine[number] = {"status": "pending", "memory": memory, "base": versions[memory], "until": now + days * DAY}
        else:
            done = "accepted" if e["event_type"] == "view" else "rejected"
            number = n[owner] - k % 40
            p = mine.get(number)
            if e["event_id"] % 17 == 0:
                outcome = "forbidden"
            elif p is None:
                outcome = "unknown"
            elif p["status"] != "pending":
                outcome = "repeated" if p["status"] == done else "conflict"
            elif done == "accepted" and p["memory"] and versions[p["memory"]] != p["base"]:
                outcome = "stale"
            else:
                outcome = done
                if done == "accepted" and p["memory"]:
                    versions[p["memory"]] += 1
                p.update(status=done, until=now + 30 * DAY)
        out[e["event_id"]] = (owner, number, outcome)
    return out


def test_proposals_over_batches_and_a_restart(spark, sf):
    where = tempfile.mkdtemp(prefix="spark-proposals-")
    parts = f"{where}/in/events.parquet"
    con = duckdb.connect()
    con.execute(f"create table e as select *, ntile(3) over (order by ts, event_id) as part from '{sf}/events.parquet'")
    shutil.os.makedirs(parts)
    put = lambda k: con.execute(f"copy (select * exclude (part) from e where part = {k}) to '{parts}/part-{k}.parquet' (format parquet)")
    run = lambda: runs.reviewed_proposals(spark, f"{where}/in", files=1, where=f"file://{where}/run", capacity=8, pending_days=3)
    put(1)
    put(2)
    assert run().count() == con.execute("select count(*) from e where part < 3").fetchone()[0]
    put(3)
    got = {r.event_id: (r.owner, r.number, r.outcome) for r in run().collect()}  # goes on from the checkpoint
    events = con.execute("select event_id, ts, epoch_us(ts) as us, user_id, event_type, json_extract(props, '$.k')::bigint as k from e").df().to_dict("records")
    want = one_by_one(events, 8, 3)
    assert got == want
    assert {"pending", "full", "invalid", "accepted", "rejected", "forbidden", "unknown"} <= {o for _, _, o in want.values()}
    shutil.rmtree(where)


def test_claims_stop_at_their_number_and_respect_leases(spark):
    table_functions.register(spark)
    jobs = [(1, 10, 1, "pending", 0, 5, 0), (1, 11, 2, "pending", 5, 1, 0), (1, 12, 3, "processing", 1, 2, 90), (1, 13, 4, "processing", 1, 3, 10), (1, 14, 5, "pending", 0, 101, 0), (1, 15, 6, "pending", 0, 50, 0), (2, 20, 7, "dead", 0, 0, 0)]
    df = spark.createDataFrame(jobs, "lane long, job_id long, memory_id long, status string, attempt int, ready_us long, leased_us long")
    ask = lambda most: spark.sql(f"SELECT job_id, attempt FROM claim_jobs(TABLE({{jobs}}) PARTITION BY lane ORDER BY (ready_us, job_id), {most}, 100L, 20L, 5)", jobs=df)
    assert [tuple(r) for r in ask(9).orderBy("job_id").collect()] == [(10, 1), (13, 2), (15, 1)]
    assert [tuple(r) for r in ask(1).collect()] == [(13, 2)]
    assert ask(9).where("false").count() == 0
    assert spark.sql("SELECT * FROM (VALUES (1, 'ab'), (2, ''), (3, NULL)) t(id, text), LATERAL memory_chunks(text)").select("id", "ordinal", "chunk").collect() == [(1, 0, "ab")]


def covers(text, query):
    """Minimal windows by trying all of them."""
    w, q = text.lower().split(), set(query.lower().split())
    if not q <= set(w):
        return None
    spans = [(i, j) for i in range(len(w)) for j in range(i, len(w)) if q <= set(w[i : j + 1])]
    least = [(i, j) for i, j in spans if not any(a >= i and b <= j and (a, b) != (i, j) for a, b in spans)]
    total = sum(0.1 / (1 + (j - i) - (sum(x in q for x in w[i : j + 1]) - 1)) for i, j in least)
    return total / (total + 1)


def test_cover_density_counts_minimal_windows(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 25)))) for i in range(60)] + [(90, None), (91, ""), (92, "a " * 3000 + "b")]
    asks = [(1, "a"), (2, "a b"), (3, "B a c"), (4, "a a"), (5, "zz a")]
    got = P.simple_cover_density(spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(asks, "query_id long, text string"))
    got = {(r.query_id, r.id): r.score for r in got.collect()}
    want = {(q, i): s for q, a in asks for i, t in docs[:-1] if t and (s := covers(t, a)) is not None}
    assert {k: round(v, 9) for k, v in got.items() if k[1] != 92} == {k: round(v, 9) for k, v in want.items()}
    assert got[2, 92] == pytest.approx(0.1 / 1.1) and (5, 92) not in got


def test_literal_answers_prefer_overlap_then_nearness(spark):
    docs = [(1, "The capital of France is Paris."), (2, "Paris, he said, lies far away from the old and very long capital of France"), (3, "Parisian capital France's"), (4, None), (5, "")]
    docs = spark.createDataFrame(docs, "id long, content string")
    asks = [(1, "What is the capital of France?", ["Paris"]), (2, "Who?", ["nobody"]), (3, "capitals", ["7", "x"]), (4, None, ["Paris"]), (5, "capital", None)]
    got = P.literal_answers(docs, spark.createDataFrame(asks, "query_id long, text string, references array<string>")).collect()
    best = {r.query_id: (r.id, r.score, r.distance) for r in got}
    # "capital" 7 letters, "France" 6 at weight 2, "Paris" 5; "frances" is anchored to "france" too, and stands nearest to "paris" in 1
    assert best[1][0] in (1, 3) and best[1][1] == 24
    assert 2 not in best and 3 not in best and 5 not in best
    assert P.nearest("paris x capital", ["paris"], ["capital"]) == pytest.approx(9.0) and P.nearest("paris", ["paris"], ["x"]) is None


def test_all_of_these_have_sql():
    assert {"stream_proposals", "claimed_job_chunks", "generation_report", "cover_density", "english_cover_density", "literal_answers", "connected_links"} <= set(ORACLE_SQL)

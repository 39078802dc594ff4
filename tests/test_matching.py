"""Query sets matched where documents are read: as the joins over postings give it, with no pair of query and document moved."""

import random

from pyspark.sql import functions as F

from gleaner.functions.stemmer import stem
from gleaner.operators import context, matching, positions, retrieval


def _tables(spark, n=400):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["walking", "walks", "walked", "the", "Über-b", "it's"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 300))))) for i in range(n)] + [(n + i, "w1 w2 walks w1") for i in range(40)] + [(9999, None), (9998, "")]
    queries = [(q, " ".join(rng.choice(words).title() if q % 3 else rng.choice(words) for _ in range(rng.choice((1, 3, 5))))) for q in range(12)] + [(50, "W1 w2 walking"), (51, ""), (52, None), (53, "absent w1"), (54, "the")]
    return spark.createDataFrame(docs, "id long, content string").repartition(5), spark.createDataFrame(queries, "query_id long, text string")


def _rows(df):
    return {(r.query_id, r.id): round(r.score, 9) for r in df.collect()}


def test_channels_are_those_of_the_postings(spark, monkeypatch):
    docs, queries = _tables(spark)
    want = retrieval.query_terms(queries)
    posted = retrieval.postings(docs, wanted=want)
    expected = {
        "strict": _rows(retrieval.strict(posted, want)), "relaxed": _rows(retrieval.relaxed(posted, want)),
        "simple": _rows(positions.cover_density(positions.positions(docs, want), want)),
    }
    found = retrieval.hits(docs, queries, ("strict", "relaxed", "simple", "english")).cache()
    for name, rows in expected.items():
        assert rows and _rows(found.where(F.col("channel") == name)) == rows, name
    # stems: walking, walks and walked are one word, stop words none
    stems = {q for q, _ in _rows(found.where("channel = 'english'"))}
    assert 50 in stems and 54 not in stems and stem("walking") == stem("walks")
    text = dict(docs.collect())
    assert {i for q, i in _rows(found.where("channel = 'english'")) if q == 50} == {i for i, t in text.items() if t and {"w1", "w2", "walk"} <= {stem(w) for w in t.lower().split()}}


def test_a_limit_keeps_what_a_ranking_may_hold(spark):
    docs, queries = _tables(spark, 2000)
    whole = retrieval.ranked(retrieval.hits(docs, queries, ("relaxed",)), F.desc(F.round("score", 9)), F.col("id"), limit=7)
    cut = retrieval.hits(docs, queries, ("relaxed",), 7)
    assert cut.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] <= 7
    best = retrieval.best_relaxed(docs, queries, 7)
    assert {(r.query_id, r.id, r["rank"]) for r in best.collect()} == {(r.query_id, r.id, r["rank"]) for r in whole.collect()}


def test_small_tiles_and_cuts_give_the_same(spark):
    docs, queries = _tables(spark)
    rows = [tuple(r) for r in retrieval.asked_words(queries, {"term"}).select("query_id", "word", "weight", "leading", "form").collect()]
    numbers = {q: k for k, q in enumerate(dict.fromkeys(r[0] for r in rows))}
    tiles = list(matching._Asked(rows, numbers).tiles())
    assert sum(t[3].sum() for t in tiles) == len(rows)
    import numpy as np
    import pyarrow as pa

    best = matching._Best(2, 3)
    for k in range(50):
        best.add(np.array([0, 1]), np.array([float(k % 5), 1.0]), pa.array([k, 100 + k]), [np.array([k, 100 + k])])
        best.cut()
    (q, score, ids, _), = best.parts
    assert sorted(zip(q.tolist(), score.tolist(), ids.to_pylist())) == [(0, 4.0, 4), (0, 4.0, 9), (0, 4.0, 14), (1, 1.0, 100), (1, 1.0, 101), (1, 1.0, 102)]


def test_only_readers_get_hits_and_take_places(spark):
    docs, queries = _tables(spark)
    asked = queries.withColumn("user_id", F.col("query_id") % 3)
    held = docs.withColumn("readers", F.when(F.col("id") % 2 == 0, F.array(F.lit(0).cast("long"), F.lit(7).cast("long"))).otherwise(F.array(F.lit(1).cast("long"))))
    got = {(r.query_id, r.id) for r in retrieval.hits(held, asked, ("relaxed",), 5).collect()}
    assert got and all(i % 2 == q % 3 for q, i in got)


def test_phrases_move_hits_only(spark):
    docs, queries = _tables(spark)
    found = retrieval.phrase(docs, queries, block=4)
    text, asked = dict(docs.collect()), dict(queries.collect())
    assert {(r.query_id, r.id) for r in found.collect()} == {(q, i) for q, s in asked.items() for i, t in text.items() if s and t and s.lower() in t.lower()}
    assert "SortMergeJoin" not in retrieval.phrase(docs, queries)._jdf.queryExecution().executedPlan().toString()


def test_groups_are_cut_before_they_meet_queries(spark):
    memories = spark.range(3000).select("id", F.lit("g").alias("group"), F.col("id").alias("ordinal"), F.timestamp_seconds(F.col("id")).alias("updated_at"))
    hits = spark.createDataFrame([(q, 2999 - q - k, k, 1.0 / k) for q in range(20) for k in range(1, 6)], "query_id long, id long, rank int, score double")
    rows = context.context_groups(hits, memories, 8, 4, 2).collect()
    assert {r["rank"] for r in rows} == set(range(1, 9)) and len(rows) == 160
    # the nearest among the 32 newest that are no hits
    for q in range(20):
        own = {2999 - q - k for k in range(1, 6)}
        newest = [i for i in range(2999, -1, -1) if i not in own][:32]
        seeds = [2999 - q - k for k in range(1, 5)]
        near = sorted(newest, key=lambda i: (min(abs(i - s) for s in seeds), i))[:4]
        assert {r.id for r in rows if r.query_id == q and r.kind == "context"} == set(near)


def test_literal_answers_move_one_row_a_query_and_task(spark, monkeypatch):
    rng = random.Random(6)
    words = ["red", "green", "boxes", "Paris", "17", "lake", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(300)] + [(700, None)]
    asks = [(q, " ".join(rng.choice(words) for _ in range(4)), ["17", "red lake", "no"][: rng.randint(1, 3)]) for q in range(9)] + [(20, "red", ["absent"]), (21, "", [])]
    monkeypatch.setattr(positions, "ASKED_AT_ONCE", 4)
    got = positions.literal_answers(spark.createDataFrame(docs, "id long, content string").repartition(3), spark.createDataFrame(asks, "query_id long, text string, references array<string>"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    anchored = {"red": "red", "green": "green", "boxes": "box", "paris": "pari", "17": None, "lake": "lake", "of": None}
    want = {}
    for q, text, refs in asks:
        terms = {}
        for w in text.split():
            if (a := anchored[w.lower()]) is not None:
                terms[a] = max(terms.get(a, 1), 2 if w[0].isupper() else 1)
        sound = [r for r in refs if len(r) >= 3 or r.isdigit()]
        for i, t in docs:
            t = (t or "").lower()
            if held := [r for r in sound if r in t]:
                own = {anchored[w] for w in t.split()}
                score = sum(x * min(len(w), 12) for w, x in terms.items() if w in own) + min(max(map(len, held)), 24)
                d = positions.nearest(t, held, list(terms))
                key = (-score, float("inf") if d is None else d, i)
                want[q] = min(want.get(q, key), key)
    assert {r.query_id: (-r.score, float("inf") if r.distance is None else r.distance, r.id) for r in got.collect()} == want

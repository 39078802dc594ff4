"""Plans that a hot key must not break: global places, packing, frames, vectors in blocks, rounds with rights."""

import random

from pyspark.sql import functions as F

from gleaner.operators import answers, context, graph, lifecycle, ranking, retrieval


def test_places_over_the_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, 7 if i % 3 else rng.randrange(50)) for i in range(4000)]
    got = ranking.placed(spark.createDataFrame(rows, "id long, v long").repartition(6), F.desc("v"), F.col("id")).collect()
    assert {r.id: r.place for r in got} == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert ranking.placed(spark.createDataFrame([], "id long, v long"), F.col("v"), F.col("id")).count() == 0


def test_a_hot_key_is_packed_row_by_row(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice((1, 5, 30, 200, None))) for k, n in ((1, 20_000), (2, 3), (None, 4)) for i in range(n)]
    got = lifecycle.packed(spark.createDataFrame(rows, "k long, i long, s long").repartition(5), "k", "i", "s", 10, 100)
    found = {(r.k, r.i): r.bin for r in got.collect()}
    want = {}
    for key in (1, 2):
        number, n, total = 0, 0, 0
        for k, i, s in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if n and (n + 1 > 10 or total + (s or 0) > 100):
                number, n, total = number + 1, 0, 0
            n, total = n + 1, total + (s or 0)
            want[k, i] = number
    assert found == want  # rows without a key are in no bin


def test_frames_that_share_their_first_word(spark):
    facts = spark.createDataFrame([(i, f"the x{i % 50} of y{i} is z{i}") for i in range(3000)], "serial long, fact string")
    frames = spark.createDataFrame([(f, f"the x{f} of y{f + 50} is ", "") for f in range(50)] + [(99, "the x1 of ", " none"), (98, "", "z7")], "frame_id long, prefix string, suffix string")
    got = {r.frame_id: (r.answer, r.serial, r.n) for r in answers.framed_answers(facts, frames).collect()}
    assert got == {f: (f"z{f + 50}", f + 50, 1) for f in range(50)} | {98: ("the x7 of y7 is ", 7, 1)}


def test_query_vectors_in_several_blocks(spark):
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    vectors = spark.createDataFrame([(i, vec()) for i in range(300)] + [(900, [0.0] * 6), (901, None), (902, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(4)
    queries = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda **k: {(r.query_id, r.id): round(r.distance, 9) for r in retrieval.semantic(vectors, queries, 0.6, **k).collect()}
    one = pairs()
    assert one and pairs(tile_rows=5, block=2) == one
    plan = retrieval.semantic(vectors, queries, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_who_leaves_between_rounds_gets_nothing_more(spark):
    memory = {1: "red", 2: "green", 3: "blue"}
    search = lambda q: q.select("query_id", F.explode(F.array(*map(F.lit, memory))).alias("id"), (10.0 - F.col("id")).alias("score") if "id" in q.columns else F.lit(1.0).alias("score"))
    asked = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, 9, "c")], "query_id long, user_id long, text string")
    every = spark.createDataFrame([(u, i) for u in (7, 8) for i in memory], "user_id long, id long")
    again = lambda hits: hits.where("rank = 1").select("query_id", F.lit("x").alias("text"), F.col("id").alias("excluded_id"))
    got = context.search_rounds(search, again, asked, [lambda: every, lambda: every.where("user_id = 7 and id <> 2")], 2).collect()
    assert {(r.query_id, r.round, r.id) for r in got} == {(1, 1, 1), (1, 2, 3)}  # user 8 left, 9 never was there, memory 2 is private by now


def test_affinity_of_all_pairs_over_tiles(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["everywhere"]
    docs = [(i, " ".join(["everywhere", *(rng.choice(words) for _ in range(rng.randint(0, 12)))])) for i in range(150)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "id long, content string").repartition(3)
    got = {(r.source, r.target): r.weight for r in graph.affinity(df, 0.3, tile=20).collect()}
    sets = {i: set((t or "").split()) for i, t in docs}
    want = {(a, b): round(len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5, 4) for a in range(150) for b in range(a + 1, 150)}
    assert got.keys() == {p for p, w in want.items() if w >= 0.3} and all(abs(got[p] - want[p]) < 1.5e-4 for p in got)
    assert graph.affinity(df, 0.3, tile=20, newest=10).agg({"source": "min"}).first()[0] >= 140
    assert graph.affinity(df.where("false")).count() == 0

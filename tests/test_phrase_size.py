"""Phrases: what a task gives at once does not grow with its hits, and no needle's text is moved or joined."""

import pyarrow as pa

from gleaner.operators import positions
from gleaner.operators.retrieval import phrase


def _tables(spark, n):
    text = " ".join(f"Word{k}" for k in range(200))
    docs = spark.createDataFrame([(i, text if i % 2 else None if i % 4 else "other words") for i in range(n)], "id long, content string")
    asked = [(f"q{k}", text[k : k + 120]) for k in range(60)] + [("twin", text[7:127].lower()), ("none", None), ("absent", "not there")]
    return docs, spark.createDataFrame(asked, "query_id string, text string"), [q for q, _ in asked[:61]]


def test_every_hit_of_common_passages_is_given(spark):
    docs, queries, held = _tables(spark, 600)
    want = sorted((q, i) for q in held for i in range(1, 600, 2))
    for block in (5000, 7):
        assert sorted(tuple(r) for r in phrase(docs, queries, block=block).collect()) == want


def test_a_pass_gives_its_hits_in_bounded_batches(spark, monkeypatch):
    docs, queries, held = _tables(spark, 2)
    passes, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: (passes.append(run), plain(df, run, schema))[1])
    phrase(docs, queries)
    text = docs.where("id = 1").first().content.lower()
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([text] * 1000)], names=["id", "normal"])
    sizes = [b.num_rows for b in passes[0](iter([batch]))]
    assert sum(sizes) == 1000 * len(held) and max(sizes) < positions.HITS_AT_ONCE + len(held)


def test_needles_meet_hits_without_a_join(spark):
    docs, queries, _ = _tables(spark, 8)
    assert "Join" not in phrase(docs, queries)._jdf.queryExecution().executedPlan().toString()

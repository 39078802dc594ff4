"""Joint packets judge and compare only what the ranked memories cite, with the rows that judging everything gives."""

from pyspark.sql import functions as F

from gleaner.operators import joint as J
from gleaner.plans import code, joint


def test_only_compared_subjects_are_asked_for(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    cites = spark.createDataFrame([(k, 10, "supports", "current", k, 100 + k) for k in range(8)] + [(50, 99, "supports", "current", 7, 500)], "evidence_id long, memory_id long, relationship string, state string, artifact_id long, subject long")
    impact = spark.createDataFrame([(s, "affected" if s == 103 else "unaffected") for s in range(100, 110)] + [(500, "affected")], "subject long, verdict string")
    asked = []

    def of(subjects):
        asked.extend(r.subject for r in subjects.collect())
        return impact.join(subjects, "subject", "left_semi")

    none = hits.where("false")
    got = {tuple(r) for r in J.packet(hits, none, cites, of).collect()}
    assert sorted(asked) == [100, 101, 102, 103, 104]
    assert got == {tuple(r) for r in J.packet(hits, none, cites, impact).collect()} and (1, "conflict", 1, "contextual-impact:affected") in got


def test_lines_of_uncited_orders_do_not_move(spark, sf, monkeypatch):
    drift, seen = code.drift_of, {}

    def of(lines, cited):
        seen["lines"], seen["cited"] = lines, cited
        return drift(lines, cited)

    monkeypatch.setattr(code, "drift_of", of)
    joint.packets(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert 0 < seen["cited"].count() < orders
    assert "SortMergeJoin" not in seen["lines"]._jdf.queryExecution().executedPlan().toString()
    assert seen["lines"].join(seen["cited"].select(F.col("evidence_id").alias("l_orderkey")), "l_orderkey", "left_anti").isEmpty()

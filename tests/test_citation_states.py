"""States of citations: reruns agree on equal candidates, and what moves with a candidate is small."""

import itertools

from pyspark.sql import functions as F

from gleaner.operators import citations as C
from gleaner.operators.code_graph import drift_state


def test_candidates_of_one_id_give_one_state_in_every_order(spark):
    rows = [(1, 5, 0, True, True, False, False), (1, 5, 0, False, False, False, False), (1, 5, 0, False, True, True, True), (1, 5, 0, True, False, True, False)]
    cited = spark.createDataFrame([(1,)], "evidence_id long")
    schema = "evidence_id long, candidate_id long, priority int, same_path boolean, same_content boolean, identity boolean, suffix boolean"
    states = {drift_state(spark.createDataFrame(list(p), schema).coalesce(1), cited, 1).first()["state"] for p in itertools.islice(itertools.permutations(rows), 0, 24, 5)}
    assert states == {"current"}


def test_a_masked_version_and_small_fingerprints(spark):
    rows = [(i, f"f{i // 4}", f"d{i // 4}" if i % 3 else None, i % 4, f"s{i % 7}", f"t{i % 11}") for i in range(200)]
    now = spark.createDataFrame(rows, "artifact_id long, path string, declaration string, ordinal int, symbol string, digest string").withColumn("digest", C.fingerprint(F.col("digest")))
    cites = C.cited(now, now.select(F.col("artifact_id").alias("evidence_id"), "artifact_id"))
    assert {r.n for r in cites.select(F.octet_length("cited_context").alias("n")).distinct().collect()} == {16, None}
    later = now.where("artifact_id % 5 <> 0")
    known = F.col("evidence_id") % 3 > 0
    masked = C.unverified(C.assessed(cites, later), known)
    assert {tuple(r) for r in masked.collect()} == {tuple(r) for r in C.assessed(cites, later, known).collect()}

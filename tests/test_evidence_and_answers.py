"""Evidence over revisions, versioned tables, joint packets, boxed answers and verified indexes by hand-written cases."""

import tempfile

import pytest
from pyspark.sql import functions as F

from gleaner.functions.boxed import boxed, evaluated
from gleaner.operators import citations as C
from gleaner.operators import joint as J
from gleaner.sources import verified, versioned

ARTIFACT = "artifact_id long, path string, declaration string, ordinal int, symbol string, digest string"


def artifacts(spark, *rows):
    return spark.createDataFrame(list(rows), ARTIFACT)


def test_states_of_citations(spark):
    before = artifacts(
        spark, (1, "a", None, 1, "s1", "x1"), (2, "b", None, 1, "s2", "x2"), (3, "c", None, 1, "s3", "x3"), (4, "d", None, 1, None, "x4"), (5, "e", "D", 1, None, "x5"), (6, "e", "D", 2, None, "x6"),
        (7, "f", None, 1, None, "x7"), (8, "g", None, 1, None, "x8"), (9, "h", "E", 1, None, "x9"),
    )
    after = artifacts(
        spark, (11, "a", None, 1, "s1", "x1"), (12, "moved", None, 1, "s2", "x2"), (13, "other", None, 1, "s3", "new"), (14, "d", None, 1, None, "y4"), (15, "e", "D", 1, None, "y5"), (16, "e", "D", 2, None, "x6"),
        (18, "g2", None, 1, None, "x8"), (19, "g3", None, 1, None, "x8"), (20, "elsewhere", "E", 7, None, "z"),
    )
    wanted = spark.createDataFrame([(i, i) for i in (*range(1, 10), 99)], "evidence_id long, artifact_id long")
    cites = C.cited(before, wanted)
    assert cites.count() == 9  # there is no artifact 99
    got = {r.evidence_id: (r.state, r.artifact_id) for r in C.assessed(cites, after).collect()}
    # 5: its own part changed and the others did not, so the masked context is the same
    assert got == {1: ("current", 11), 2: ("moved", 12), 3: ("changed", 13), 4: ("changed", 14), 5: ("changed", 15), 6: ("current", 16), 7: ("deleted", None), 8: ("ambiguous", None), 9: ("ambiguous", None)}
    unknown = C.assessed(cites, after, F.col("evidence_id") > 1)
    assert unknown.where("evidence_id = 1").first().state == "unverifiable" and unknown.where("state = 'unverifiable'").count() == 1
    assert C.assessed(cites.where("false"), after).count() == 0
    assert {r.state for r in C.assessed(cites, after.where("false")).collect()} == {"deleted"}


def test_one_content_in_very_many_artifacts_makes_few_candidates(spark):
    many = spark.range(20_000).select(F.col("id").alias("artifact_id"), F.concat(F.lit("p"), "id").alias("path"), F.lit(None).cast("string").alias("declaration"), F.lit(1).alias("ordinal"), F.lit("s").alias("symbol"), F.lit("same").alias("digest"))
    cites = C.cited(many, many.select(F.col("artifact_id").alias("evidence_id"), "artifact_id"))
    assert {r.state: r.n for r in C.assessed(cites, many).groupBy("state").agg(F.count("*").alias("n")).collect()} == {"current": 20_000}


def test_versions_are_read_merged_and_written_again(spark):
    where = "file://" + tempfile.mkdtemp(prefix="spark-versions-")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    at = lambda v: {r.k: r.v for r in versioned.as_of(spark, where, v, ["k"]).collect()}
    with pytest.raises(ValueError):
        at(1)
    versioned.append(rows((1, "a"), (2, "b")), where, 1)
    versioned.append(rows((2, "lost")), where, 2)
    versioned.append(rows((2, "B"), (3, None)), where, 2)  # a repeated write of a version replaces it
    versioned.append(rows((1, "A")), where, 3)
    want = {1: {1: "a", 2: "b"}, 2: {1: "a", 2: "B", 3: None}, 3: {1: "A", 2: "B", 3: None}}
    assert {v: at(v) for v in want} == want and at(9) == want[3]
    versioned.merge(spark, where, 2, ["k"])
    assert {v: at(v) for v in want} == want
    versioned.expire(spark, where, 2)
    assert at(2) == want[2] and at(3) == want[3]
    with pytest.raises(ValueError):
        at(1)
    with pytest.raises(ValueError):
        versioned.expire(spark, where, 3)


def test_packets_put_anchored_first_and_mark_conflicts(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, id long, rank int")
    code = spark.createDataFrame([(1, 70, 1), (1, 71, 2), (3, 72, 1)], "query_id long, id long, rank int")
    cites = [(100, 11, "contradicts", "changed", 71, 5), (101, 11, "supports", "current", 73, 6), (102, 12, "supports", "deleted", None, 7)]
    cites = spark.createDataFrame(cites, "evidence_id long, memory_id long, relationship string, state string, artifact_id long, subject long")
    impact = spark.createDataFrame([(5, "unaffected"), (6, "affected")], "subject long, verdict string")
    rows = J.packet(hits, code, cites, impact).collect()
    of = lambda q, k: [r.item for r in sorted(rows, key=lambda r: r.position) if r.query_id == q and r.kind == k]
    assert of(1, "memory") == ["11", "12", "10"] and of(2, "memory") == ["10"]
    assert of(1, "code") == ["71", "73", "70"] and of(3, "code") == ["72"]
    assert of(1, "anchor") == ["100:contradicts:changed", "101:supports:current", "102:supports:deleted"]
    assert of(1, "conflict") == ["anchor:100:contradicts", "anchor:100:changed", "anchor:102:deleted", "contextual-impact:affected"]
    routes = {r.query_id: r.route for r in J.delivered(J.packet(hits, code, cites, impact)).collect()}
    assert routes == {1: "both", 2: "memory-only", 3: "code-only"}
    assert J.anchors(hits, cites, 2).count() == 2
    assert J.packet(hits.where("false"), code.where("false"), cites, impact).count() == 0


BOXES = {
    r"\boxed{42}": "42", r"a \boxed{x} b \boxed{y}": "y", r"\boxed{a {b} c}": "a {b} c", r"\boxed{{}}": "{}", r"\boxed{open {b}": r"\boxed{open {b}", r"\boxed{ }": r"\boxed{ }", "  plain ": "plain",
    r"\boxed{a \boxed{b}}": "b", r"x} \boxed{ y }}": "y", "": "", r"\boxed{": r"\boxed{", r"\boxed{a}\boxed{": r"\boxed{a}\boxed{",
}


def test_boxes(spark):
    got = spark.createDataFrame([(k,) for k in BOXES], "t string").select("t", boxed(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in got} == BOXES
    assert spark.createDataFrame([(None,)], "t string").select(boxed(F.col("t"))).first()[0] is None


def test_evaluators(spark):
    cases = [
        ("A-b, c!", "C; a b", "norm_phrase_set_match", True), ("a, c", "c, a", "norm_phrase_set_match_ordered", False), ("ｆｕｌｌ", "FULL", "norm_phrase_set_match", True), ("a，b", "a b", "norm_phrase_set_match", True),
        ("a|b", "b|a", "norm_phrase_set_match|separators=/", True), ("a/b", "b/a", "norm_phrase_set_match|separators=/", True), ("a]b", "b]a", "norm_phrase_set_match|separators=]^", True), ("", "", "norm_phrase_set_match", False),
        (r"\boxed{B}", "b", "mc_choice_match", True), ("A, C", "C A", "mc_choice_match", False), ("A, C", "C A", "mc_choice_set_match", True), ("AB", "AB", "mc_choice_match", False), ("x", "y", "llm_gotchas_checker", None),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "prediction string, reference string, evaluator string")
    got = {(r.prediction, r.evaluator): (r.correct, r.judge) for r in evaluated(df).collect()}
    assert got[("a|b", "norm_phrase_set_match|separators=/")][0] is False  # one phrase each, of different order
    for p, _, e, correct in cases:
        if p != "a|b":
            assert got[p, e][0] == correct, (p, e)
    assert got["x", "llm_gotchas_checker"][1] == "gotchas"
    with pytest.raises(Exception, match="unsupported evaluator"):
        evaluated(spark.createDataFrame([("a", "a", "other")], "prediction string, reference string, evaluator string")).collect()


def test_bags_and_indexes(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "n")], "k long, v string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("c", 3), ("c", 3), ("n", None), ("d", 4)], "v string, k long")
    assert {r.k for r in verified.differing(left, right, ["k"]).collect()} == {1, 3, 4}
    assert verified.differing(left, left.repartition(3), ["k"]).count() == 0
    expected = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a"), (4, 0, "x"), (4, 1, "y")], "id long, ordinal int, chunk string")
    stored = spark.createDataFrame([(1, 0, "a", "r"), (1, 1, "b", "r"), (2, 0, "A", "r"), (4, 0, "x", "r"), (4, 1, "y", None), (9, 0, "z", "r")], "id long, ordinal int, chunk string, revision string")
    got = {r.id: (r.outcome, r.ordinal) for r in verified.index_outcomes(expected, stored, "r").collect()}
    assert got == {1: ("exact", None), 2: ("chunk", 0), 3: ("incomplete", None), 4: ("chunk", 1), 9: ("incomplete", None)}
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("z", 0, "q")], "f string, bytes long, sha256 string")
    wanted = spark.createDataFrame([("a", 1, "x"), ("b", 2, "n"), ("c", 1, "x")], "f string, bytes long, sha256 string")
    assert {r.f: r.outcome for r in verified.verified(files, wanted, "f").collect()} == {"a": "verified", "b": "mismatch", "c": "missing", "z": "unexpected"}

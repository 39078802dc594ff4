import hashlib
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions.chunking import chunks, line_pieces
from gleaner.functions.json_tools import canonical
from gleaner.operators.diversity import diversified
from gleaner.operators.graph import capped
from gleaner.functions.stemmer import stemmed
from gleaner.operators.lifecycle import packed
from gleaner.operators.retrieval import evidence, memory_search, phrase
from gleaner.sources.sinks import export_manifest
from gleaner.streaming import runs


def test_chunks_are_cut_where_the_rule_says():
    """Expected pieces written by hand; windows of [ceil(most / 2), most]."""
    for most, pieces in (
        (12, ["one two\n\n", "three four ", "five"]),  # a paragraph before anything else
        (12, ["one two\n \t\n", "three fours"]),  # a line of blanks ends a paragraph
        (14, ["aaaa bbb\n", "- item one ", "more"]),  # the start of a list item
        (14, ["aaaa bbb\r\n", "12) next one ", "xxyyzz"]),
        (12, ["aaaa bbb\n", "# head more ", "text"]),
        (12, ["aa bbbb. ", "cc dddddd"]),  # a sentence before a later blank
        (12, ["aa bbbb; ", "cc dddddd"]),
        (12, ["aa bbbb； ", "cc dddddd"]),
        (12, ["aa bbb!』》 ", "cc dddddd"]),
        (12, ["aa bbbb» cc ", "dddddd"]),  # no closing mark of a sentence
        (12, ["aa bbbb… cc ", "dddddd"]),  # no sentence end
        (10, ["aaa bbb\n", "cc dd ee"]),  # a line end before a later blank
        (8, ["aaa bbb ", "ccc"]),
        (4, ["abcd", "efgh", "i"]),
        (5, ["abc\r\n", "def"]),
        (4, ["abc", "\r\n", "def"]),  # CR LF stays whole
        (6, ["a.    ", "      ", "      ", "bcde"]),
    ):
        assert chunks("".join(pieces), most) == pieces, (most, pieces)


def test_a_sentence_ends_after_any_run_of_blanks():
    text = "a" * 30 + "." + " " * 5000 + "b" * 30
    got = chunks(text, 40)
    assert "".join(got) == text and all(len(c) <= 40 for c in got)
    assert got[0] == text[:40] and got[-1].endswith("b" * 30)
    started = time.perf_counter()
    chunks(" " * 2_000_000 + "x" + ".)" * 500_000 + "\n \n" * 200_000, 1200)
    assert time.perf_counter() - started < 20


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!;)\n\r\t\"》…#-1", max_size=160), st.integers(2, 40))
def test_chunks_keep_the_text_and_their_bounds(text, most):
    got = chunks(text, most)
    assert "".join(got) == text and all(0 < len(c) <= most for c in got)
    for c, after in zip(got, got[1:]):
        assert not (c.endswith("\r") and after.startswith("\n")) or len(c) == 1 or most < 3
        assert len(c) >= min(most - 1, -(-most // 2))


def test_blank_pieces_can_be_rejected():
    assert chunks("a" * 10 + " " * 30, 10)[-1] == " " * 10
    with pytest.raises(ValueError):
        chunks("a" * 10 + " " * 30, 10, reject_blank=True)
    with pytest.raises(ValueError):
        chunks("a", 0)


def test_chunks_edge_cases():
    assert chunks(None) == chunks("") == []
    assert chunks("x" * 2500) == ["x" * 1200, "x" * 1200, "x" * 100]
    assert "\r" not in {c[-1] for c in chunks("ab\r\n" * 700)}


def test_capped_is_the_sequential_choice(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(30), rng.randrange(30, 60)) for _ in range(200)})
    rows = [(a, b, round(rng.random(), 1)) for a, b in edges]
    taken, degree = set(), {}
    for a, b, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            taken.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    got = capped(spark.createDataFrame(rows, "source long, target long, weight double"), 3).collect()
    assert {(r.source, r.target) for r in got} == taken


def test_diversified_prefers_new_terms(spark):
    hits = spark.createDataFrame([(1, 10, 1, "red fox"), (1, 11, 2, "red fox"), (1, 12, 3, "blue sea")], "query_id long, id long, rank int, evidence string")
    got = {r.position: r.id for r in diversified(hits, 3, 0.5).collect()}
    assert [got[i] for i in (1, 2, 3)] == [10, 12, 11]


def test_canonical_json():
    assert canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'


def test_memory_search_uses_every_channel_and_only_readable_memories(spark):
    # user 7 is in workspace 1 and 8 in 2; memory 6 is private to 8, 9 to 7
    home = {1: (1, 0, "shared"), 2: (1, 0, "shared"), 3: (1, 0, "shared"), 4: (2, 0, "shared"), 5: (1, 0, "shared"), 6: (1, 8, "private"), 9: (1, 7, "private")}
    texts = [(1, 0, "red fox"), (1, 1, "red fox runs"), (2, 0, "東京タワーへ"), (3, 0, "none"), (4, 0, "red fox"), (5, 0, "the Grey Owl"), (6, 0, "red fox"), (9, 0, "blue whale")]
    memory = "id long, ordinal int, workspace_id long, owner_id long, scope string, updated_at long"
    pieces = spark.createDataFrame([(i, o, *home[i], i, t) for i, o, t in texts], memory + ", chunk string")
    asked = [(1, 7, "red fox"), (2, 7, "東京タワー"), (3, 7, "zebra"), (4, 7, "Grey Owl"), (5, 8, "red fox"), (6, 7, "blue whale"), (7, 8, "blue whale"), (8, 9, "red fox")]
    queries = spark.createDataFrame(asked, "query_id long, user_id long, text string")
    readable = spark.createDataFrame([(7, 1, "active"), (8, 2, "active"), (9, 1, "left")], "user_id long, workspace_id long, status string")
    vectors = spark.createDataFrame([(i, 0, *home[i], i, [1.0, 0.0]) for i in (3, 4)], memory + ", embedding array<float>")
    wanted = spark.createDataFrame([(3, [1.0, 0.1])], "query_id long, embedding array<float>")
    rows = memory_search(pieces, queries, readable, vectors, wanted, 5).collect()
    # the two chunks of memory 1 tie in the strict, the relaxed and the English channel; the later one is first, its score counts alone
    assert {(r.query_id, r.id): round(r.score, 9) for r in rows} == {(1, 1): round(3 / 61, 9), (2, 2): round(1 / 61, 9), (3, 3): round(1 / 61, 9), (4, 5): round(3 / 61, 9), (5, 4): round(3 / 61, 9), (6, 9): round(3 / 61, 9)}
    more = memory_search(pieces, queries, readable, vectors, wanted, 5, with_aliases=True).where("query_id = 4").collect()
    assert [(r.id, round(r.score, 9)) for r in more] == [(5, round(4 / 61, 9))]


def test_stems_are_those_of_the_paper(spark):
    pairs = (
        "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size "
        "hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc "
        "hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper "
        "feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal "
        "electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens "
        "irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog "
        "effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is yes ye été été"
    ).split()
    want = dict(zip(pairs[::2], pairs[1::2]))
    got = {r.term: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in want], "term string")).collect()}
    assert got == want


def test_evidence_is_the_anchor_with_its_neighbours(spark):
    pieces = spark.createDataFrame([(d, o, f"<{d}.{o}>") for d in (1, 2) for o in range(6)], "id long, ordinal int, chunk string")
    anchors = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (7, 2, 5), (8, 1, 3), (9, 1, 40)], "query_id long, id long, ordinal int")
    got = {(r.query_id, r.id): (r.evidence, r.n_chunks) for r in evidence(pieces, anchors).collect()}
    assert got == {(7, 1): ("<1.0><1.1><1.2>", 3), (7, 2): ("<2.4><2.5>", 2), (8, 1): ("<1.2><1.3><1.4>", 3)}
    assert {r.evidence for r in evidence(pieces, anchors, neighbors=0).collect()} == {"<1.0><1.1>", "<2.5>", "<1.3>"}


def test_manifest_counts_and_adds_up_row_hashes(spark):
    rows = [(1, "a"), (2, None), (3, "ä")]
    digests = [hashlib.sha256(json.dumps({"id": i, "text": t}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for i, t in rows]
    df = spark.createDataFrame(rows, "id long, text string")
    want = ("memories", 3, str(sum(int(x[:13], 16) for x in digests)))
    for some in (df, df.repartition(3), df.select("text", "id")):
        got = export_manifest({"memories": some, "none": df.where("false")}).collect()
        assert tuple(got[0]) == want and tuple(got[1]) == ("none", 0, "0")


def test_phrases_inside_words_and_of_few_terms(spark):
    docs = spark.createDataFrame([(1, "x the quick-brown foxes ran"), (2, "THE QUICK-BROWN FOX"), (3, "nothing"), (4, "'red' - fox")], "id long, content string")
    asked = [(1, "he quick-brown fox"), (2, "oth"), (3, "quick-brown"), (4, "red' - f"), (5, ""), (6, "- ")]
    got = {(r.query_id, r.id) for r in phrase(docs, spark.createDataFrame(asked, "query_id long, text string"), block=2).collect()}
    assert got == {(q, i) for q, t in asked if t for i, c in ((r.id, r.content) for r in docs.collect()) if t.lower() in c.lower()}


def test_streams_keep_state_over_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(5).write.parquet(f"file://{tmp_path}/events.parquet")
    for run, want in ((runs.daily_counts, events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))), (runs.first_requests, events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts")))):
        got = run(spark, f"file://{tmp_path}", files=1)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_bins_close_before_a_bound_is_passed(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.choice((1, 50, 200, 900))) for k in range(4) for o in range(25)]
    got = {(r.k, r.o): r.bin for r in packed(spark.createDataFrame(rows, "k long, o long, size long"), "k", "o", "size", 4, 600).collect()}
    for k in range(4):
        n = total = at = 0
        for _, o, size in (r for r in rows if r[0] == k):
            if n and (n + 1 > 4 or total + size > 600):
                at, n, total = at + 1, 0, 0
            n, total = n + 1, total + size
            assert got[k, o] == at


def test_line_pieces():
    assert line_pieces("ab\ncd\nef", 6) == ["ab\ncd\n", "ef"]
    assert line_pieces("abcdefgh", 3) == ["abc", "def", "gh"]
    assert line_pieces("a🙂🙂b", 4) == ["a🙂", "🙂b"]
    assert line_pieces("\nabcdef", 4) == ["\nabc", "def"]
    assert line_pieces(None, 4) == [] and "".join(line_pieces("x\n" * 9999, 6000)) == "x\n" * 9999

"""Source mixing against a packet-by-packet queue, and odd inputs."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from gleaner.llm import mixing


def one_by_one(rows: list, packet: int, passes: int, budget: int) -> dict[tuple, int]:
    """Words taken of each source by serving packets in the order of their virtual finish times.

    ``rows``: (source, begin, words, source's size, its target), one for equal documents.
    """
    queue = []
    for source, begin, words, size, target in rows:
        for p in range(passes):
            at = p * size + begin
            for k in range(0, words, packet):
                n = min(packet, words - k)
                queue.append(((at + k + n) / target, source is None, source or "", at + k + n, n))
    queue.sort()
    left, served = budget, Counter()
    for _, null, source, _, n in queue:
        took = min(n, left)
        left -= took
        served[None if null else source] += took
    return served


def corpus(seed: int = 5) -> list:
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice((1, 3, 40, 300, 1000)), rng.choice(("a", "a", "a", "b", "c", None))) for i in range(300)]
    rows += [(900, "tiny source", "z")] + [(901, "same text " * 200, "a")] * 40 + [(None, "no id " * 30, "b")] * 7 + [(902, None, "b"), (903, " ", None)]
    return rows


def test_taken_follows_the_global_order(spark):
    docs = spark.createDataFrame([(*r, "x") for r in corpus()], "doc_id long, text string, source string, lang string")
    queued = mixing.queue(docs)
    q = queued.collect()
    rows = [(r.source, r.begin, r["size"] * r.copies, r.source_size, r.target) for r in q if r["size"]]
    budget = sum(r[2] for r in rows)
    served = one_by_one(rows, mixing.PACKET, mixing.MAX_PASSES, budget)
    assert sum(served.values()) == budget
    target = {r[0]: r[4] for r in rows}
    assert all(abs(served[s] - t) <= mixing.PACKET for s, t in target.items()), (served, target)
    want = defaultdict(list)
    for r in q:
        for k in range(r.copies):
            begin = r.begin + k * r["size"]
            want[r.doc_id, r.source, r["size"]].append(sum(max(0, min(r["size"], served[r.source] - p * r.source_size - begin)) for p in range(3)))
    got = defaultdict(list)
    for r in mixing.report(queued).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect():
        if r.doc_id is not None:
            got[r.doc_id, r.source, r["size"]].append(r.taken)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if k[0] is not None}
    again = mixing.report(mixing.queue(docs.repartition(7))).collect()
    assert Counter(again) == Counter(mixing.report(queued).collect())


def test_begins_are_contiguous(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.queue(docs).collect():
        by[r.source].append((r.begin, r.begin + r["size"] * r.copies))
    for parts in by.values():
        parts = sorted(p for p in parts if p[0] < p[1])
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_stage_serves_what_the_report_takes(spark):
    clash = "doc_id long, text string, source string, target string, begin long, size long, pass int, virtual_finish string, copies int, words_taken string"
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, "v", 4, "w") for r in corpus()], clash)
    mixed = mixing.stage(spark, docs, "")
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    took = Counter()
    for r in mixing.report(mixing.queue(docs)).where("doc_id is not null").join(docs.select("doc_id", "source").distinct(), "doc_id").collect():
        took[r.source] += r.taken
    for s in ("a", "c", "z", None):  # "b" also holds rows without doc_id
        assert words[s] == took[s], s
    assert mixing.stage(spark, docs.where("false"), "").count() == 0
    assert mixing.report(mixing.queue(docs.where("false"))).count() == 0
    assert mixing.stage(spark, docs.where("text is null"), "").count() == 0


def test_many_equal_rows_are_dealt_evenly(spark):
    few = mixing._spread(spark.createDataFrame([(1, 5), (2, 0), (3, 200_000)], "id long, n long"), mixing.F.col("n"), "k")
    got = few.groupBy("id").agg(mixing.F.count("*").alias("c"), mixing.F.max("k").alias("m"), mixing.F.countDistinct("k").alias("d")).collect()
    assert {(r.id, r.c, r.m, r.d) for r in got} == {(1, 5, 4, 5), (3, 200_000, 199_999, 200_000)}


def test_targets_are_exact_shares(spark):
    sizes = [("a", 1000), ("b", 50), ("c", 400), ("d", 7)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight, free, left = {"a": 5, "b": 2, "c": 1, "d": 5}, {s for s, _ in sizes}, Fraction(sum(n for _, n in sizes))
    want = {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * dict(sizes)[s]}
        want |= {s: Fraction(3 * dict(sizes)[s]) for s in over} if over else share
        left -= sum(3 * dict(sizes)[s] for s in over)
        free = free - over if over else set()
    assert all(abs(got[s] - float(t)) < 1e-6 for s, t in want.items())

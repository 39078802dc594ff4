"""Near-duplicate documents against a comparison of all pairs, and odd inputs."""

import random
from collections import Counter

from gleaner.llm import links, minhash


def near_copies(seed: int, groups: int, most: int) -> list[tuple[int, str]]:
    """Documents in groups: chains of copies with more and more words replaced, some exact, some far apart."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(groups):
        words = [word() for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(1, most)):
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                words[rng.randrange(len(words))] = word()
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def all_pairs(rows: list[tuple[int, str]], idf: minhash.Idf) -> dict[int, int]:
    """Smallest doc_id of each document's component of pairs that reach the threshold."""
    sets = [minhash.weighted(t, idf) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_classes_equal_those_of_all_pairs(spark):
    rows = near_copies(3, 40, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = all_pairs(rows, minhash.frequencies(docs))
    assert 40 <= len(set(want.values())) < len(rows) / 2
    for sizes in ((2, 2, 400), (512, 512, 1 << 20)):
        got = {r.doc_id: (r.class_id, r.kept) for r in minhash.classes(docs, star_rows=sizes[0], tile_rows=sizes[1], tile_shingles=sizes[2]).collect()}
        assert {k: c for k, (c, _) in got.items()} == want
        assert all(kept == (k == c) for k, (c, kept) in got.items())


def test_shingles_are_five_words():
    text = "The cat sat on the mat the cat sat on THE mat the cat"
    words = text.lower().split()
    want = Counter(zip(*(words[i:] for i in range(5))))
    h, tf = minhash.shingles(text)
    assert sorted(tf.tolist()) == sorted(want.values())
    assert len(minhash.shingles("three words only")[0]) == 1 and not len(minhash.shingles(" \n")[0])
    long = "ab " * 400_000  # longer than what is hashed at once
    assert minhash.shingles(long)[1].tolist() == [400_000 - 4]


def test_repeated_ids_and_rows(spark):
    a, b = "one two three four five six seven eight nine ten " * 3, "other words that are not like the first ones at all"
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, a, "y"), (2, b, "z"), (3, None, "n"), (3, None, "n"), (4, "", "n"), (None, a, "n"), (None, a, "n"), (5, a + "and one more", "q")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, class_id int, n int")
    got = minhash.classes(docs).select("doc_id", "class_id", "kept").collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None), (5, 1)}
    left = minhash.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("1", a), ("1", b), ("3", ""), ("3", ""), ("4", ""), ("None", a), ("None", a)])
    assert minhash.stage(spark, docs.where("false"), "").count() == 0
    assert minhash.classes(docs.where("false")).count() == 0


def test_components_and_roots(spark):
    rng = random.Random(1)
    edges = [(i + 1, i) for i in range(40)] + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        a, b = sorted((root(x), root(y)))
        up[b] = a
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    parents = [(i, rng.randrange(i)) for i in range(1, 60)] + [(i, i - 1) for i in range(101, 140)]
    got = {r.node: r.component for r in links.roots(spark.createDataFrame(parents, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 140)}

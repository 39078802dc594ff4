"""The filter audit, byte-level BPE and importance resampling against independent results, and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
import regex
import tiktoken

from gleaner.llm import audit, bpe, importance
from gleaner.llm.common import small_batches, tokenizer_file
from gleaner.llm.queries import ORACLE_SQL, QUERIES

from ..compare import normal, oracle

ODD = [
    (3, "same words here", "b"), (1, "same words here", "a"), (1, "same words here", None), (None, "same words here", "b"), (2, None, ""), (4, "", None), (5, "", "c"),
    (6, "Long Text # " * 30_000, "c"), (7, "é🙂漢字 " * 300, "a"), (7, "é🙂漢字 " * 300, "a"), (8, "x" * 200_000, "a"), (9, "ABC def, it's 12 o'clock & they'll\u0085go\x1c on\t\n", "b"),
]
SCHEMA = "doc_id long, text string, source string, part string, ids string, rank string, digest int, weight int, before int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "p", "i", "r", 1, 2, 3) for r in ODD], SCHEMA)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_importance_resample"])
def test_equals_sql(spark, sf, name):
    got, want = normal(QUERIES[name](spark, sf).toPandas()), normal(oracle(ORACLE_SQL[name], sf))
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


# --- filter audit ---


def one_by_one(rows, labels):
    """The report by walking every order over every document."""
    label = {d: (q, t) for d, q, t in labels}
    seen = {}
    for d, text, _ in rows:
        if d is not None:
            seen[text or ""] = min(d, seen.get(text or "", d))
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > seen[t],
        }
        docs.append((source or "", fails, *label.get(d, (0, 0))))
    out = {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in docs}:
            standing = [x for x in docs if x[0] == part]
            fallen = []
            for k, f in enumerate(order, 1):
                removed = [x for x in standing if x[1][f]]
                alone = sum(x[0] == part and x[1][f] and sum(x[1].values()) == 1 for x in docs)
                standing = [x for x in standing if not x[1][f]]
                out[part, "".join(order), k] = (len(standing), len(removed), sum(x[1][f] for x in fallen), alone, sum(x[2] == 1 for x in removed), sum(x[3] == 1 for x in removed))
                fallen += removed
    return out


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (6, 0, 1), (9, 1, 1), (3, None, 1)]
    table = spark.createDataFrame([*labels, (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = audit.report(odd, table).collect()
    want = one_by_one(ODD, labels)
    assert {(r["part"], r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in got} == want
    shapley = Counter()
    for (part, order, k), x in want.items():
        shapley[part, order[k - 1]] += x[1]
    assert all(r.shapley == shapley[r["part"], r.filter_order[r.step - 1]] for r in got)
    assert audit.report(odd.where("false"), table).count() == 0
    assert audit.report(odd, table.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def test_audit_of_a_hot_text_and_many_parts(spark):
    rng = random.Random(4)
    rows = [(i, "hot copy #" if i % 3 == 0 else f"text {rng.randrange(900)}", f"s{rng.randrange(700)}" if i % 2 else "s0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = audit.report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r["part"]: (r.kept, r.removed) for r in got.where("filter_order = 'EABCD' and step = 1").collect()}
    first = {}
    for d, t, _ in rows:
        first.setdefault(t, d)
    want = {p: (sum(first[t] == d for d, t, q in rows if q == p), sum(first[t] < d for d, t, q in rows if q == p)) for p in {p for _, _, p in rows}}
    assert got == want


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def coder():
    m = bpe.Merges(tokenizer_file(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=bpe.public_pattern(), mergeable_ranks=m.rank, special_tokens={})
    return m, bpe.word_cutter(bpe.public_pattern()), library


def test_replay_equals_the_library(coder):
    m, cut, library = coder
    rng = random.Random(1)
    letters = [*"abcdeéß🙂 \n\t'sl12漢rvem", "  ", "\x1c", "\x85", "'re", "n't", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(8000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(500)]  # few letters: merges that touch and make lower ranks
    texts += ["".join(rng.choice("-=*_.") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 3000, " " * 9000, "x" * 100_000, bytes(range(128)).decode() * 50, "", None, " ", "'", "'s", " 's", "''s", "'sx't"]
    ids = m.encode(texts, cut)
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode_ordinary(t or ""), t
        assert m.decode(x.tolist()) == (t or "").encode()
    assert m.encode([], cut) == []


def test_words_by_classes_are_the_patterns_words():
    classes, pattern = bpe.letter_classes(), regex.compile(bpe.PUBLIC)
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3500 or c % 7 == 0)]
    by_class, by_pattern = bpe.classed(texts, classes), bpe.matched(texts, pattern)
    assert by_class[0].equals(by_pattern[0]) and (by_class[1] == by_pattern[1]).all()


def test_other_patterns_and_ranks(coder):
    m = bpe.Merges(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    pattern = r"\s*\S+|\s+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=m.rank, special_tokens={})
    texts = ["Größe der Häuser, naïve façade", "", "漢字かな混じり文 12  x"]
    assert [x.tolist() for x in m.encode(texts, bpe.word_cutter(pattern))] == [library.encode_ordinary(t) for t in texts]


def test_bpe_query_and_odd_rows(spark, sf, odd, coder):
    def digest(doc_id, text):
        ids = coder[2].encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(digest(r.doc_id, r.text) for r in docs.collect())
    assert Counter(tuple(r) for r in QUERIES["op12_byte_bpe"](spark, sf).collect()) == want
    small_batches(spark, 3)
    coded = bpe.encode(odd, carry=tuple(c for c in odd.columns if c not in ("text", "ids")))
    assert set(odd.columns) - {"text"} <= set(coded.columns)
    back = bpe.decode(coded)
    assert "ids" not in back.columns
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((d, (t or "").encode()) for d, t, _ in ODD)
    assert bpe.decode(bpe.encode(odd.where("false"))).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nothing).first().decoded) == b""


# --- importance resampling ---

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_crcs_of_ngrams_are_composed_exactly():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abC d1é漢\n.🙂") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["x" * 300 + " y" + "é" * 200 + " z", "", None, "a" * 63 + " " + "b" * 64 + " " + "c" * 65, "q" * 70_000 + " q"]
    words, count, crcs, owners = importance.features(pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 3)
    found = [WORDS.findall(lowered(t)) for t in texts]
    assert words.tolist() == [len(w) for w in found]
    assert count.tolist() == [sum(max(0, len(w) - n) for n in range(3)) for w in found]
    for n in (1, 2, 3):
        assert crcs[n - 1].tolist() == [zlib.crc32(" ".join(w[i : i + n]).encode()) for w in found for i in range(len(w) - n + 1)]
        assert owners[n - 1].tolist() == [k for k, w in enumerate(found) for _ in range(len(w) - n + 1)]


def test_resample_of_odd_rows(spark, odd):
    target = ["the words of a target", None, "it's 12 o'clock", "long text"]
    got = importance.resample(odd, spark.createDataFrame([(1, t) for t in target], "item_id long, text string")).collect()
    feats = lambda t: [f for w in [WORDS.findall(lowered(t))] for f in (*w, *(" ".join(p) for p in zip(w, w[1:])))]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x, _ in ODD for f in feats(x)), Counter(bucket(f) for x in target for f in feats(x))
    ratio = lambda b: (t[b] + 1.0) * (s.total() + 10_000) / ((s[b] + 1.0) * (t.total() + 10_000))
    rows = []
    for d, x, _ in ODD:
        f = feats(x)
        weight = sum(math.floor(1000 * math.log(ratio(bucket(k)))) for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((-r[3], r[0] is None, r[0] or 0) for r, (_, x, _) in zip(rows, ODD) if len(WORDS.findall(lowered(x))) >= 20)
    drawn = [(d if not null else None, i) for i, (_, null, d) in enumerate(enough[: 25 * len(enough) // 100], 1)]
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
    assert [(r.doc_id, r["rank"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(odd.where("false"), empty).count() == 0
    assert importance.resample(odd, empty).count() == len(ODD)


def test_ranks_follow_a_global_order(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice((5, 5, 5, rng.randrange(1000)))) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = importance.ranked(df, importance.F.col("v").desc(), importance.F.col("id").asc()).collect()
    want = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {(r.id, r.v): r["rank"] for r in got} == want

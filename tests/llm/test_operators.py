"""The training-data operators against brute force, the libraries, planted cases and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import embeddings, html_text, minhash, mixing, pieces, pii, quality, token_store, toxicity, url_filter
from gleaner.llm.common import fresh_dir, tokenizer_file
from gleaner.llm.labelled_pages import labelled_pages
from gleaner.llm.queries import ORACLE_SQL, QUERIES

from ..compare import normal, oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None), (2, "", "b"), (3, "x " * 30_000, "a"), (4, "same words here to compare now", "a"), (4, "same words here to compare now", "a"), (None, "no key", None), (5, "\n \t", "b"), (6, "é🙂\u2581 ", "b")]


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_words int")


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert normal(QUERIES[name](spark, sf).toPandas()).equals(normal(oracle(ORACLE_SQL[name], sf)))


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, None], 1), (10, [1e300, 0.0], 1), (2, [2.0, 0.01], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile_rows=2).collect()
    assert len(got) == len(rows)
    linked = {r.vec_id: (r.n_links, r.component_id) for r in got if r.n_links}
    assert linked == {1: (3, 1), 2: (3, 1), 10: (3, 1)}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_mix_meets_targets(spark, sf):
    got = QUERIES["op2_source_mix"](spark, sf).collect()
    full = texts(spark, sf)
    assert all(r["size"] == len(WORD.findall(full[r.doc_id] or "")) and r.taken <= 3 * r["size"] for r in got)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else share
        left -= sum(3.0 * sizes[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert math.isclose(r.target, target[source[r.doc_id]], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= mixing.PACKET for s in names)
    assert mixing.report(mixing.queue(odd_docs(spark))).count() == len(ODD)
    assert mixing.report(mixing.queue(odd_docs(spark).where("false"))).count() == 0


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL))
    codec = pieces.codec(tokenizer_file(pieces.MODEL))
    rng = random.Random(5)
    cases = ["", " ", "   x", "a  b \n c\n\n", "🙂é\u2581q", "\x00"] + ["".join(rng.choice("ab the\n \u2581é你") for _ in range(rng.randint(1, 50))) for _ in range(500)] + [t for t in texts(spark, sf).values() if t]
    for t, packed in zip(cases, codec.encode(cases)):
        ids = np.frombuffer(packed, codec.width).tolist()
        assert ids == lib.encode(t)
        assert codec.decode(ids) == lib.decode(ids)
    got = pieces.encode(odd_docs(spark).select("doc_id", "text")).collect()
    assert len(got) == len(ODD) and all(r.restored for r in got)
    assert {r.text for r in pieces.decode(pieces.encode(odd_docs(spark).select("doc_id", "text"))).collect()} >= {"", "no key"}


def test_unigram_path_is_the_best():
    c = object.__new__(pieces.Codec)
    import ahocorasick

    score = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -9.0, "c": -1.0, "bc": -2.2}
    c.bpe, c.text_of, c.score = False, list(score), list(score.values())
    c.sizes, c.lowest, c.byte, c.unknown, c.chars = [len(p) for p in score], -20.0, {}, 99, {p for p in score if len(p) == 1}
    c.machine = ahocorasick.Automaton()
    for i, p in enumerate(score):
        c.machine.add_word(p, (i, len(p)))
    c.machine.make_automaton()

    def best(s):
        if not s:
            return 0.0
        return max((score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score), default=-1e9)

    for s in ("abc", "abcabc", "aabbcc", "cab"):
        ids = c.path(s)
        assert "".join(c.text_of[i] for i in ids) == s
        assert math.isclose(sum(c.score[i] for i in ids), best(s))


def test_html_held_out_pages(spark):
    model = html_text.trained()
    right = total = 0
    for page, article in labelled_pages(150, seed=77):
        got, rows = html_text.blocks(page)
        verdict = model.decode(rows)
        right += sum(bool(v) == (t in article) for t, v in zip(got, verdict))
        total += len(got)
    assert right / total > 0.98
    pages = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (None, None, "<p>", 1), (3, "u", "<article><h1>A &amp; B</h1><p>One\n two.<p>Three" + " x" * 50_000 + "</article><script>no</script>", 1), (4, "u", "<" * 2000, 1)], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert rows[1].text == rows[2].text == "" and rows[3].text.startswith("A & B\nOne two.\nThree x") and "no" not in rows[3].text
    assert rows[3].n_chars == len(rows[3].text)


def test_token_store_round_trip(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file(token_store.MODEL))
    full, start = texts(spark, sf), 0
    got = {r.doc_id: r for r in QUERIES["op5_token_store"](spark, sf).collect()}
    for k in sorted(full):
        ids = [*lib.encode(full[k] or "", add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    docs = odd_docs(spark)
    where = fresh_dir(spark, "odd")
    token_store.write(docs, where, shard_rows=2)
    assert token_store.lookup(docs, where).count() == len(ODD)
    assert token_store.lookup(spark.createDataFrame([(77,)], "doc_id long"), where).count() == 0
    hot = spark.createDataFrame([(7, f"text {i % 3}") for i in range(40)] + [(None, "same text")] * 40 + [(i, "x") for i in range(20)], "doc_id long, text string").repartition(8)
    full = fresh_dir(spark, "hot")
    manifest = token_store.write(hot, full, shard_rows=4)
    assert manifest.count() > 12 and manifest.where("n_null > 0").count() > 3 and manifest.where("low <= 7 and high >= 7").count() > 2
    every = token_store.lookup(hot, full, with_ids=True).orderBy("start").collect()
    assert len(every) == 100 and [r.start for r in every] == np.cumsum([0] + [r.n_tokens for r in every])[:-1].tolist()
    assert Counter((r.doc_id, lib.decode(r.ids[:-1])) for r in every) == Counter((r.doc_id, r.text) for r in hot.collect())
    assert token_store.lookup(spark.createDataFrame([(7,), (99,)], "doc_id long"), full).count() == 41
    empty = fresh_dir(spark, "none")
    token_store.write(docs.where("false"), empty)
    assert token_store.lookup(docs, empty).count() == 0


def test_token_store_looks_up_distinct_words(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    c = token_store.Encoder(tokenizer_file(token_store.MODEL))
    c.memo = Counted()
    rng = random.Random(5)
    same = [" ".join(rng.choices(["the", "words,", "Größe.", "été", "3"], k=200)) + "\nthe words," for _ in range(100)]
    pick = [*"aZéßſ.,!#'$01 -\t\r\n\0\xa0\u2028\u3000漢🙂", " ", " ", " the", "\n", "\nWord", "ing.", "'s", "!!!", "<|endoftext|>"]
    odd = ["", None, " ", "\n", "a\n", "\na", "a\r\nb", "\n\xa0a", "a \nb", "x" * 3000 + ".", "!" * 300, *("".join(rng.choices(pick, k=rng.randint(1, 12))) for _ in range(4000))]
    for texts in (same, odd, same[:3] + odd[:40], []):
        got = c.encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(g, c.width).tolist() for g in got] == [e.ids for e in c.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if texts is same:  # five words after a space and at the start of a line
            assert c.memo.asked == 10
    assert max(map(len, c.memo)) <= token_store.LONGEST_KEPT
    monkeypatch.setattr(token_store, "GROUP", 500)
    columns = [pa.array(odd[k : k + 70], pa.string()) for k in range(0, len(odd), 70)]
    cut = list(token_store.groups(iter([pa.array([], pa.string()), *columns])))
    assert [t for g in cut for t in g.to_pylist()] == odd and len(cut) > 20
    sizes = [[len((t or "").encode()) for t in g.to_pylist()] for g in cut]
    assert all(sum(n) - max(n) < 1000 for n in sizes)


def test_mph_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    assert sorted(token_store.Mph.build(keys).slots(keys)) == list(range(len(keys)))


def test_quality_base_counts(spark, sf):
    full = texts(spark, sf)
    for r in QUERIES["op6_quality_rules"](spark, sf).collect():
        t = full[r.doc_id] or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i]) if len(lines) < 400 else r.n_dup_lines
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated), failed)
        assert not (failed and r.kept)
    got = quality.judge(odd_docs(spark), quality.all_content(quality.N_FEATURES)).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)


def test_pii_base_spans(spark, sf):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    def base(t):
        digits = lambda x: re.sub(r"[^0-9]", "", x)
        found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        found += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
        return ",".join(f"{k}:{a}:{b}" for k, (a, b) in found)

    rng = random.Random(9)
    cases = ["".join(rng.choice("ab.@-1234567890+() ") for _ in range(200)) for _ in range(300)] + ["x@y.z@w.v a@b@c.d", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 010-9999", "", None]
    cases += [t for t in texts(spark, sf).values() if t and len(t) < 20_000]
    for t in cases:
        assert pii.written(pii.spans(t), pii.BASE) == base(t or ""), t
    got = pii.find(odd_docs(spark)).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert "a@b.cd" not in pii.masked("write to a@b.cd now") and pii.mask(odd_docs(spark)).count() == len(ODD)


def test_toxicity_scores_words_over_their_whole_length():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("an", "re", "th", "on", "ti", "en", "sh")) for _ in range(rng.randint(1, 4)))
    docs = [" ".join([*(word() for _ in range(30)), *([rng.choice(("grobnik", "zulfant"))] if i % 3 == 0 else []), word()]) for i in range(300)]
    model = toxicity.train(docs, np.array([i % 3 == 0 for i in range(300)]))

    def score(t):
        s = toxicity.sentences(t)
        return model.score(model.margin(s, {w: float(model.contributions([toxicity.plain(w)])[0]) for x in s for w in x}))

    filler = "".join(word() for _ in range(40))
    assert len(filler) > 100
    for join in ("{0}{1}{0}", "{0}-{1}.{0}", "{0}{1}"):
        assert score(join.format(filler, "grobnik")) >= toxicity.THRESHOLD, join
        assert score(join.format(filler, "zulfant")) >= toxicity.THRESHOLD, join
    assert score(" ".join(filler + "grobnik" + filler)) >= toxicity.THRESHOLD
    assert score(filler * 3) < toxicity.THRESHOLD and score(" ".join(filler)) < toxicity.THRESHOLD


def test_toxicity_learns_from_few_labels():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("an", "re", "th", "on", "ti", "en", "sh")) for _ in range(rng.randint(1, 4)))
    # six toxic texts of 30, three for each insult
    bad = {0: "grobnik", 5: "zulfant", 10: "grobnik", 15: "zulfant", 20: "grobnik", 25: "zulfant"}
    docs = [" ".join([*(word() for _ in range(20)), *([bad[i]] if i in bad else [])]) for i in range(30)]
    model = toxicity.train(docs, np.array([i in bad for i in range(30)]))
    assert model is not None
    score = lambda t: model.score(model.margin([t.split()], {w: float(model.contributions([w])[0]) for w in t.split()}))
    assert score("an grobnik re") >= toxicity.THRESHOLD and score("an zulfant re") >= toxicity.THRESHOLD
    assert score("an re then") < toxicity.THRESHOLD
    for odd in (["!!", "?"], ["same words here", "same words here"], ["an on", "re ti"]):
        assert toxicity.train(odd, np.array([True, False])) is not None


def test_toxicity_learns_insults(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("an", "re", "th", "on", "ti", "en", "sh")) for _ in range(rng.randint(1, 4)))
    insults = ("grobnik", "zulfant", "pwexol")
    docs, toxic = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(insults)
        docs.append(" ".join(w[:20]) + ". " + " ".join(w[20:]) + ".")
        toxic.append(bad)
    model = toxicity.train(docs[:300], np.array(toxic[:300]))

    def score(t):
        s = toxicity.sentences(t)
        return model.score(model.margin(s, {w: float(model.contributions([toxicity.plain(w)])[0]) for x in s for w in x}))

    wrong = sum((score(t) >= toxicity.THRESHOLD) != y for t, y in zip(docs[300:], toxic[300:]))
    assert wrong <= 2
    for t in ("an g.r.o.b.n.i.k on", "re zul-fant ti", "an p w e x o l re", "th GROBNIKK."):
        assert score(t) >= toxicity.THRESHOLD, t
    assert toxicity.score(odd_docs(spark), model).count() == len(ODD)
    assert {r.score for r in toxicity.score(odd_docs(spark), None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fitted(odd_docs(spark), labels) is None


def test_url_rules(spark):
    urls = [("http://A.Example.NET/en/x?q", "example.net/en/", "allow"), ("http://b.net", None, "allow"), ("http://b.net/", "net/", "block"), ("https://example.com/de/1", "example.com/de/", "block"), ("nothing", None, "allow"), (None, None, "allow"), ("x://y.org/fr/#z", "org/fr/", "allow"), ("x://notexample.com/de/", None, "allow")]
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = url_filter.judge(pages, url_filter.fixed_rules(spark), sweep_points=2).collect()
    assert len(got) == 2 * len(urls)
    assert all((r.rule, r.verdict) == urls[r.page_id][1:] for r in got)


def test_minhash_groups(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(12)]
    rows, group = [], {}
    for g, words in enumerate(base):
        for _ in range(1 + g % 4):
            w = list(words)
            if len(rows) % 2:
                w[rng.randrange(200)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    smallest = {}
    for k, g in group.items():
        smallest.setdefault(g, k)
    assert got == {k: smallest[g] for k, g in group.items()}
    odd = minhash.classes(odd_docs(spark)).collect()
    assert len(odd) == len(ODD)

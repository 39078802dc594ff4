"""Planted cases, held-out accuracy, odd inputs and empty tables of the operators and stages."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline as P
from gleaner.llm import html_text, minhash, mixing, pieces, pii, quality, token_store, toxicity, url_filter
from gleaner.llm.common import fresh_dir

SYLLABLES = ("an", "re", "th", "on", "ti", "en", "sh")
INSULTS = ("grobnik", "zulfant", "pwexol", "idiot")


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def insulted():
    rng, docs, toxic = random.Random(2), [], []
    for i in range(400):
        w = [word(rng) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(INSULTS)
        docs.append(" ".join(w[:20]) + ". " + " ".join(w[20:]) + ".")
        toxic.append(i % 4 == 0)
    return toxicity.train(docs, np.array(toxic))


def score(model, text):
    s = toxicity.sentences(text)
    return model.score(model.margin(s, {w: float(model.contributions([toxicity.plain(w)])[0]) for x in s for w in x}))


def test_toxicity_tolerates_inserted_and_dropped_letters(insulted):
    rng = random.Random(7)
    for insult in INSULTS:
        for at in range(1, len(insult)):
            for put in "xqb":
                text = f"an re {insult[:at]}{put}{insult[at:]} thon"
                assert score(insulted, text) >= toxicity.THRESHOLD, text
        for at in range(2, len(insult) - 1):
            text = f"an re {insult[:at]}{insult[at + 1 :]} thon"
            assert score(insulted, text) >= toxicity.THRESHOLD, text
        for prefix in ("xyz", "pre", "an"):
            assert score(insulted, f"on {prefix}{insult} re") >= toxicity.THRESHOLD, prefix + insult
        assert score(insulted, f"on {insult[:3]}{insult[2:]} re") >= toxicity.THRESHOLD
    clean = [score(insulted, " ".join(word(rng) for _ in range(40))) for _ in range(300)]
    assert max(clean) < toxicity.THRESHOLD


def test_toxicity_tolerates_two_letters_in_most_places(insulted):
    rng, hits, n = random.Random(8), 0, 0
    for insult in ("grobnik", "zulfant", "pwexol"):
        for _ in range(40):
            w = list(insult)
            for _ in range(2):
                w.insert(rng.randrange(1, len(w)), rng.choice("qwyxkbm"))
            hits += score(insulted, f"an re {''.join(w)} thon") >= toxicity.THRESHOLD
            n += 1
    assert hits >= 0.6 * n, hits / n


def test_toxicity_learns_beginnings_of_words_in_a_rarer_language():
    """Insults are a beginning with changing endings; the beginning as a word, and within words, is harmless."""
    rng = random.Random(12)
    other = lambda: "".join(rng.choice(("ach", "lich", "ung", "ver", "ein", "ß")) for _ in range(rng.randint(1, 4)))
    endings = ("ung", "ver", "lichß", "ein", "achver", "ungein", "liché", "över")

    def text(rare, bad):
        w = [other() if rare else word(rng) for _ in range(80)]
        if rare:
            w[5] = "zorlich" if rng.random() < 0.5 else "verzorlich" + rng.choice(endings)
        for _ in range(4 if bad else 0):
            w[rng.randrange(6, 80)] = "zorlich" + rng.choice(endings) if rare else rng.choice(INSULTS)
        return ". ".join(" ".join(w[i : i + 16]) for i in range(0, 80, 16)) + "."

    kinds = [(False, True)] * 120 + [(False, False)] * 300 + [(True, True)] * 30 + [(True, False)] * 90
    model = toxicity.train([text(*k) for k in kinds], np.array([bad for _, bad in kinds]))
    caught = lambda rare, bad, n: sum(score(model, text(rare, bad)) >= toxicity.THRESHOLD for _ in range(n))
    assert caught(False, True, 60) >= 58 and caught(True, True, 60) >= 54
    assert caught(False, False, 60) <= 1 and caught(True, False, 60) <= 8


def test_html_takes_what_only_deep_or_sloppy_pages_hold():
    model = html_text.trained()
    text = "This is a long sentence of an article, with many words and a comma, that reads like the content of a page. " * 3
    one = " ".join(text.split())
    for page in (
        f"<html><head><title>x</title><p>{text}",
        f'<body><article><p title="{"y" * 5000} > not text">{text}</article>',
        f"<body><article><noscript><p>{text}</p></article>",
        f"<body><article><p>{text}</p><template>",
        f"<body><iframe><article><p>{text}</p></article>",
    ):
        assert html_text.main_text(page, model) == one, page[:60]
    assert html_text.main_text(f"<article><p>{text}<math><mi>x</mi><mo>=</mo><mn>2</mn></math> done.</p></article>", model).endswith("x=2 done.")
    deep = "".join(f'<div class="c{i} box{i}">' for i in range(60))
    tags = "<section><ul><li><dl><dd><table><tr><td><blockquote><figure><details><fieldset><label><address>"
    inside = '<div class="widget rail side promo share related tags meta byline container wrapper page story text body"><p>'
    assert html_text.main_text(f"<body><article><p>{text}</p></article><footer class='comments'>{tags}{deep}{inside}Short words, here.</p>", model) == one


def test_html_scanning_is_linear():
    def seconds(page):
        t = time.perf_counter()
        html_text.blocks(page)
        return time.perf_counter() - t

    for make in (
        lambda k: "<div class='a b'>" * k + "x" + "</span></p>" * k,
        lambda k: "".join(f"<div class='footer c{i}'><p>t{i}" for i in range(k)),
        lambda k: "<b><i>" * k + "</u></i>" * k,
        lambda k: '<a "><a" ' * k,
        lambda k: "<iframe>x" * k + "<template>" * k,
        lambda k: "<li>" * k + "<table><td>" * k,
        lambda k: "<" * k + "<!--" * k,
    ):
        seconds(make(100))
        assert seconds(make(20_000)) < 8


def test_html_text_of_given_pages(spark, sf):
    """Blocks of the single article element are kept, words that only stand outside it are not."""
    import re
    from html import unescape

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    kept = lost = leaked = outside = 0
    strip = lambda h: unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style|title|noscript)\b.*?</\1>|<!--.*?-->", " ", h))).split()
    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        h = pages[r.page_id]
        if len(re.findall(r"<article\b", h)) != 1 or "</article>" not in h:
            continue
        before, rest = re.split(r"<article\b[^>]*>", h, maxsplit=1)
        inner, after = rest.split("</article>", 1)
        if re.search(r"(?i)comment|aside|advert|\bad\b|share|related|form|notice", inner):
            continue
        got, want = set(r.text.split()), strip(inner)
        kept += sum(w in got for w in want)
        lost += sum(w not in got for w in want)
        only = set(strip(before)) | set(strip(after))
        only -= set(want)
        outside += len(only)
        leaked += len(only & got)
    assert kept > 500 and lost <= 0.01 * kept and leaked <= 0.02 * max(1, outside), (kept, lost, leaked, outside)


def test_pii_added_kinds():
    found = lambda t: pii.written(pii.spans(t), (*pii.BASE, *pii.ADDED))
    assert found("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF") == "iban:5:32"
    assert found("FR1420041010050500013M02606 Paris") == "iban:0:27"
    assert found("DE89 3704 0044 0532 0130 01 Bank") == ""
    assert found("hotel 555-123-4567") == "" and found("taxi 123-45-6789") == ""
    assert found("tel. 555-123-4567") == "local_phone:5:17"
    assert found("my ssn 123-45-6789") == "ssn:7:18"
    assert found("visa card 378282246310005") == "card15:10:25"
    assert found("password = hunter2000") == "secret:0:21"


def test_quality_verdict_on_held_out_documents():
    rng = random.Random(3)

    def text(good):
        if good:
            lines = [" ".join(word(rng) for _ in range(rng.randint(6, 18))).capitalize() + "." for _ in range(12)]
        else:
            lines = [rng.choice(("### " + word(rng).upper() + " *** $$$", " | ".join(word(rng) for _ in range(9)), word(rng).upper() + "!!! " * 3, "www." + word(rng) + " %%% 123 456 <<>>")) for _ in range(24)]
            lines += [" ".join(word(rng) for _ in range(6)) for _ in range(3)]
        rng.shuffle(lines)
        return "\n".join(lines)

    train = [(text(g), g) for g in [True, False] * 60]
    model = quality.fit([quality.line_features(t)[0] for t, _ in train], [np.full(len(quality.line_features(t)[0]), int(g), np.int8) for t, g in train], quality.N_FEATURES)
    held = [(text(g), g) for g in [True, False] * 60]
    right = sum((quality.content_share(model, t) >= quality.CONTENT_SHARE) == g for t, g in held)
    assert right >= 0.97 * len(held)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "target string, begin long, size long, pass int, n_tokens string, ids string, kept boolean, class_id string, score string, spans string, served long, digest string, n int, v int, f int, q int"
ODD = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, "word " * 40_000, "en", "a", 1), (4, "some words that stay here for all to read " * 9, "en", "a", 1), (4, "some words that stay here for all to read " * 9, "en", "a", 1), (None, "no key but text " * 20, None, None, 1), (None, "no key but text " * 20, None, None, 1), (5, "\n \t", "en", "b", 1), (6, "é🙂▁ ", "en", "b", 1)]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows_clashing_columns_and_nothing(spark, sf, k):
    name, work = P.STAGES[k]
    extra = (None, 1, 2, 3, "t", "i", True, "c", "s", "p", 4, "d", 5, 6, 7, 8)
    docs = spark.createDataFrame([(*r, *extra) for r in ODD], f"{DOCS}, {CLASH}")
    got = work(spark, docs, sf)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if k < 4:
        assert got.columns == docs.columns
    if k == 1:
        assert len(rows) == len(ODD) - 1  # one of the two rows that repeat doc_id and text
    if k in (2, 4):
        assert len(rows) == len(ODD)
    assert work(spark, docs.where("false"), sf).count() == 0


def test_operators_on_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert pieces.encode(docs).count() == 0
    assert html_text.extract(pages).count() == 0
    assert quality.judge(docs, quality.all_content(quality.N_FEATURES)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is not None and toxicity.fitted(docs, labels) is None
    assert pii.find(docs).count() == 0 and pii.mask(docs).count() == 0
    assert toxicity.score(docs, None).count() == 0
    assert url_filter.judge(pages, url_filter.fixed_rules(spark)).count() == 0
    assert minhash.classes(docs).count() == 0
    assert mixing.report(mixing.queue(docs)).count() == 0
    where = fresh_dir(spark, "none")
    token_store.write(docs, where)
    assert token_store.lookup(docs, where).count() == 0

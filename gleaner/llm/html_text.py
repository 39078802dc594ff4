"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read once by a tolerant tag scanner that keeps the stack of open elements (unclosed
and misnested tags included). A leaf block is the text between two block-level boundaries; it
carries binary features of its ancestors' tags, of the words in their class, id and role
attributes, and of its own text (length, share of link text, punctuation, ...). The CRF is trained on
labelled pages (see ``labelled_pages``: generated layouts whose blocks are labelled by construction)
and Viterbi decoding marks each block as article or not. Article blocks, character references
decoded and white space collapsed, are joined by line feeds in page order.

Defined cases: null, empty and tagless pages are handled like any other (a page without tags is one
block); a page without an article block has the empty text; null or repeated page_ids pass row by
row; extra columns are ignored; an empty table gives no rows. A head that was left open ends where
something starts that no head holds; a script or style without an end tag hides the rest of the
page, other unclosed raw elements hide nothing; from a quote that is never closed on, tags end at
their first ``>``. Nothing is cut or capped: attributes and words may have any length, a block carries the
features of all its ancestors, and scanning is linear in the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .crf import Crf, fit
from .labelled_pages import labelled_pages

#: Labelled pages that the CRF is fitted on.
TRAIN_PAGES = 800

#: A comment, a declaration or the name of a tag.
_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*))")
#: The rest of a tag whose quoted values may hold ``>``.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
_MUTE = frozenset("script style template noscript iframe svg canvas object audio video title select textarea datalist head annotation annotation-xml".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript", "template")}
#: Without an end tag these hide the rest of the page; the others of the list above end where they begin.
_TO_END = frozenset(("script", "style"))
#: What a head may hold; anything else ends a head that was left open.
_HEAD = frozenset("head title meta link script style base noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others begin and end a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mfenced menclose semantics".split()
)
#: An opening tag closes these, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_BLOCK_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_ANCESTORS = (
    "nav header footer aside article main section form fieldset button label ul ol li dl table td th tr p h1 h2 h3 h4 h5 h6 "
    "blockquote figure figcaption pre div dialog details summary address center body"
).split()
_WORDS = (
    "nav menu navbar navigation breadcrumb breadcrumbs header masthead banner logo footer foot copyright legal sidebar side rail widget aside complementary "
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments reply replies respond discussion disqus form search login signup subscribe newsletter share sharing social related recommended recommendations more "
    "tags tag meta byline author pagination pager paywall content main article post entry body story text page container wrapper feedback reviews contentinfo"
).split()
_TAG_AT = {t: i for i, t in enumerate(_ANCESTORS)}
_WORD_AT = {w: len(_ANCESTORS) + i for i, w in enumerate(_WORDS)}
_OWN = len(_ANCESTORS) + len(_WORDS)  # the innermost block element
_TEXT = _OWN + len(_ANCESTORS) + 1
_SIZES, _LINKS = (2, 4, 8, 15, 30, 60), (0.01, 0.5, 0.95)
N_FEATURES = _TEXT + len(_SIZES) + 1 + len(_LINKS) + 1 + 6
_closing = re.compile(r"[.!?…。]['\"”»)\]]*$")
_legal = re.compile(r"©|\(c\)|copyright|all rights|cookie|privacy", re.I)


def _marks(tag: str, attrs: str) -> tuple[int, ...]:
    """Features that an element gives to all blocks inside it."""
    got = [_TAG_AT[tag]] if tag in _TAG_AT else []
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            for w in _PART.findall(m[2] or m[3] or m[4] or ""):
                k = _WORD_AT.get(w.lower())
                if k is not None and k not in got:
                    got.append(k)
    return tuple(got)


class _Open:
    """The open elements, the features that they give and where each tag was opened."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...], bool]] = []  # tag, marks, mute
        self.at: dict[str, list[int]] = {}  # of each tag its places on the stack
        self.solid: list[int] = []  # places of elements that are no part of a line
        self.active: dict[int, int] = {}  # of each feature how many open elements give it
        self.mute = 0

    def top(self, tag: str) -> int:
        """Place of the innermost open element of a tag, -1 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def push(self, tag: str, marks: tuple[int, ...]) -> None:
        silent = tag in _MUTE
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in _INLINE:
            self.solid.append(len(self.stack))
        for k in marks:
            self.active[k] = self.active.get(k, 0) + 1
        self.mute += silent
        self.stack.append((tag, marks, silent))

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, marks, silent = self.stack.pop()
            self.at[tag].pop()
            if tag not in _INLINE:
                self.solid.pop()
            for k in marks:
                if self.active[k] == 1:
                    del self.active[k]
                else:
                    self.active[k] -= 1
            self.mute -= silent

    def innermost(self) -> int:
        """Place of the innermost element that is no part of a line."""
        return self.solid[-1] if self.solid else -1

    def end(self, tag: str) -> None:
        """An end tag; one of a line closes nothing beyond its block."""
        i = self.top(tag)
        if i >= 0 and (tag not in _INLINE or i > self.innermost()):
            self.pop(i)

    def start(self, tag: str) -> None:
        """What a start tag closes."""
        if self.mute and tag not in _HEAD and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)
        if tag == "body":  # also ends a head that was left open
            self.pop(0)
        elif tag in _BLOCK_CLOSES_P:
            if self.top("p") >= 0 and self.top("p") == self.innermost():
                self.pop(self.top("p"))
        elif tag in _CLOSES:
            gone, stop = _CLOSES[tag]
            least = max(map(self.top, stop))
            while (i := max(map(self.top, gone))) > least:
                self.pop(i)


def blocks(html: str | None) -> tuple[list[str], np.ndarray]:
    """Texts and feature rows of a page's leaf blocks, in page order; rows are padded to the longest."""
    texts: list[str] = []
    rows: list[list[int]] = []
    if not html:
        return texts, np.zeros((0, 1), np.int32)
    tree = _Open()
    buf: list[str] = []
    linked: list[str] = []  # the part of buf inside links
    after_head = False
    cache: dict[tuple[str, str], tuple[int, ...]] = {}

    def flush() -> None:
        nonlocal after_head
        if not buf:
            return
        text = " ".join(unescape("".join(buf)).split())
        if text:
            links = len(" ".join(unescape("".join(linked)).split())) / len(text) if linked else 0.0
            i = tree.innermost()
            own = _TAG_AT.get(tree.stack[i][0], len(_ANCESTORS)) if i >= 0 else len(_ANCESTORS)
            row = list(tree.active)
            n = text.count(" ") + 1
            row.append(_OWN + own)
            row.append(_TEXT + sum(n >= e for e in _SIZES))
            at = _TEXT + len(_SIZES) + 1
            row.append(at + sum(links >= e for e in _LINKS))
            at += len(_LINKS) + 1
            row.append(at)  # bias
            if _closing.search(text[-8:]):
                row.append(at + 1)
            if n <= 40 and _legal.search(text):
                row.append(at + 2)
            if "," in text:
                row.append(at + 3)
            if after_head:
                row.append(at + 4)
            if own == _TAG_AT["h1"]:
                after_head = True
                row.append(at + 5)
            rows.append(row)
            texts.append(text)
        buf.clear()
        linked.clear()

    at, size, last, quotes = 0, len(html), html.rfind(">"), True
    endless: set[str] = set()  # raw elements without an end tag from here on
    while at < size:
        m = _OPEN.search(html, at) if at <= last else None
        start = m.start() if m else size
        if start > at:
            if tree.mute and tree.stack[-1][0] == "head" and not html[at:start].isspace():
                tree.pop(len(tree.stack) - 1)
            if not tree.mute:
                buf.append(html[at:start])
                if tree.top("a") >= 0:
                    linked.append(html[at:start])
        if not m:
            break
        if m[1]:  # a comment
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else size
            continue
        rest = _REST.match(html, m.end()) if quotes and m[3] else None
        if rest:
            end = rest.end() - 1
        else:
            if m[3]:  # a quote is never closed: from here on tags end at the first >
                quotes = False
            end = html.find(">", m.end())
            if end < 0:  # no tag: it is text
                if not tree.mute:
                    buf.append(html[start:])
                break
        at = end + 1
        if m[3] is None:
            continue
        tag, attrs = m[3].lower(), html[m.end() : end]
        if tag not in _INLINE:
            flush()
        elif tag == "br" and not tree.mute:
            buf.append(" ")
        if m[2]:
            tree.end(tag)
            continue
        if tag not in _VOID:
            tree.start(tag)
        elif tag not in _HEAD and tree.mute and tree.stack[-1][0] == "head":
            tree.pop(len(tree.stack) - 1)
        if tag in _VOID:
            if tag == "hr":
                tree.start(tag)
            continue
        if tag in _RAW:
            found = None if tag in endless else _RAW[tag].search(html, at)
            if found:
                at = found.end()
            else:
                endless.add(tag)
                at = size if tag in _TO_END else at
            continue
        if attrs.endswith("/") and tag not in _INLINE and tag not in _TAG_AT:
            continue
        key = (tag, attrs)
        marks = cache.get(key)
        if marks is None:
            marks = cache[key] = _marks(tag, attrs)
        tree.push(tag, marks)
    flush()
    return texts, padded(rows)


def padded(rows: list[list[int]], width: int = 1) -> np.ndarray:
    """Feature rows as one array, as wide as the longest; the padding has no weight."""
    width = max([width, *map(len, rows)])
    return np.array([r + [N_FEATURES] * (width - len(r)) for r in rows], np.int32).reshape(len(rows), width)


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES) -> Crf:
    """The CRF fitted on labelled pages."""
    seqs, labels = [], []
    for html, article in labelled_pages(pages):
        texts, rows = blocks(html)
        seqs.append(rows)
        labels.append(np.array([t in article for t in texts], np.int8))
    width = max(s.shape[1] for s in seqs)
    seqs = [np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=N_FEATURES) for s in seqs]
    return fit(seqs, labels, N_FEATURES, l2=0.005, rounds=120, rate=0.2)


def main_text(html: str | None, model: Crf) -> str:
    texts, rows = blocks(html)
    return "\n".join(t for t, k in zip(texts, model.decode(rows).tolist()) if k)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b in batches:
            texts = [main_text(h, crf) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))

"""Labelled pages for the HTML extractor: generated layouts whose blocks are labelled by construction.

Each page puts an article (with its own headings, lists, quotations, tables, sloppy markup)
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Which
of the usual hints a part shows (its element, a class or id word, only its links) is drawn at random, so
that no single hint decides. The generator is seeded: the same number gives the same pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pe qui ra so ta un ve wi xa yo zu er on st th re ion ment ung que ado ñi é ü".split()
_MENU = "Home News Sport Shop About Contact Archive Topics Video Careers Help Login Start Inicio Accueil".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.article, self.seen = rng, set(), set()

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice((1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 20) -> str:
        s = self.words(low, high).capitalize()
        if self.rng.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s + self.rng.choice("....!?")

    def block(self, content: bool, low: int, high: int, sentences: int = 1) -> str:
        """A block's text, unlike any other of the page; sometimes junk, symbols or capitals."""
        r = self.rng
        while True:
            text = " ".join(self.sentence(low, high) for _ in range(sentences))
            kind = r.random()
            if kind < 0.06:
                text = " ".join(w + r.choice(("***", "$$$", "###", "%%%")) for w in text.split())
            elif kind < 0.1:
                text = " ".join(w.upper() + "!!" for w in text.split())
            elif kind < 0.25:
                text = text.rstrip(".!?")
            if text not in self.seen:
                break
        self.seen.add(text)
        if content:
            self.article.add(text)
        return text

    def inline(self, text: str, links: float = 0.15) -> str:
        r = self.rng
        words = text.split(" ")
        if len(words) > 3 and r.random() < 0.4:
            i = r.randrange(len(words) - 1)
            tag = r.choice(("b", "i", "em", "strong", "span"))
            words[i] = f"<{tag}>{words[i]}</{tag}>"
        if len(words) > 5 and r.random() < links:
            i = r.randrange(len(words) - 1)
            words[i] = f'<a href="/{i}">{words[i]}</a>'
        return " ".join(words)

    def hint(self, tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, str]:
        """Opening and closing tag of a part."""
        r = self.rng
        tag = r.choice(tags)
        name = r.choice(names)
        if r.random() < 0.3:
            name = f"{r.choice(('site', 'page', 'top', 'left', 'x1', 'block'))}-{name}"
        plain = tag not in ("div", "section", "p", "ul", "td")
        attr = "" if plain and r.random() < 0.5 else f' {r.choice(("class", "class", "id"))}="{name}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def links(self, n: int, low: int = 1, high: int = 3) -> str:
        r = self.rng
        style = r.random()
        texts = [r.choice(_MENU) if r.random() < 0.3 else self.block(False, low, high) for _ in range(n)]
        if style < 0.7:
            close = "</li>" if r.random() < 0.8 else ""
            return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a>{close}' for i, t in enumerate(texts)) + "</ul>"
        if style < 0.85:
            return "".join(f'<div><a href="/{i}">{t}</a></div>' for i, t in enumerate(texts))
        return " | ".join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts))

    def part(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            a, b = self.hint(("nav", "nav", "div", "ul"), ("nav", "menu", "navbar", "navigation", "breadcrumbs"))
            inner = self.links(r.randint(3, 9))
            return a + (inner.removeprefix("<ul>").removesuffix("</ul>") if a.startswith("<ul") else inner) + b
        if kind == "header":
            a, b = self.hint(("header", "div"), ("header", "masthead", "banner", "logo"))
            return a + f"<div>{self.block(False, 1, 4)}</div>" + (f"<p>{self.block(False, 2, 8)}</p>" if r.random() < 0.5 else "") + b
        if kind == "footer":
            a, b = self.hint(("footer", "footer", "div"), ("footer", "foot", "legal", "contentinfo"))
            own = r.choice(("&copy; ", "Copyright ", "")) + self.block(False, 2, 10)
            return a + (f"<p>{own}</p>" if r.random() < 0.5 else own) + (self.links(r.randint(2, 4)) if r.random() < 0.4 else "") + b
        if kind == "side":
            a, b = self.hint(("aside", "div", "div", "section"), ("sidebar", "rail", "widget", "related", "recommended", "aside", "social", "share", "tags"))
            inner = "".join(f"<p>{self.inline(self.block(False, 4, 18, r.choice((1, 1, 2))))}</p>" for _ in range(r.randint(0, 2)))
            return a + (f"<h3>{self.block(False, 1, 4)}</h3>" if r.random() < 0.6 else "") + (self.links(r.randint(2, 5), 2, 7) if not inner or r.random() < 0.6 else "") + inner + b
        if kind == "ad":
            a, b = self.hint(("div", "div", "aside", "section", "p"), ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"))
            text = self.inline(self.block(False, 2, 16, r.choice((1, 1, 2))), 0.3)
            return a + (text if a.startswith("<p") or r.random() < 0.6 else f"<p>{text}</p>") + b
        if kind == "notice":
            a, b = self.hint(("div", "div", "section", "dialog", "aside"), ("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "paywall", "notification"))
            text = self.block(False, 4, 20, r.choice((1, 2)))
            return a + (f"<p>{self.inline(text)}</p>" if r.random() < 0.6 else self.inline(text)) + (f"<button>{self.block(False, 1, 2)}</button>" if r.random() < 0.6 else "") + b
        if kind == "form":
            a, b = self.hint(("form", "form", "div"), ("form", "search", "newsletter", "subscribe", "login", "signup", "feedback"))
            inner = (f"<p>{self.block(False, 3, 12)}</p>" if r.random() < 0.5 else "") + f"<label>{self.block(False, 1, 4)}</label><input type=text>"
            return a + (inner if a.startswith("<form") else f"<form>{inner}</form>") + f"<button>{self.block(False, 1, 3)}</button>" + b
        if kind == "comments":
            a, b = self.hint(("section", "div", "div"), ("comments", "replies", "discussion", "respond", "reviews", "comment-list"))
            one = r.choice(('<div class="comment">', '<li class="comment">', "<div>", "<article>", '<article class="comment">', '<div class="reply">'))
            end = "</" + one[1:].split(" ")[0].rstrip(">") + ">"
            head = f"<h2>{self.block(False, 1, 4)}</h2>" if r.random() < 0.7 else ""
            body = "".join(one + (f"<b>{self.block(False, 1, 2)}</b>" if r.random() < 0.5 else "") + f"<p>{self.inline(self.block(False, 2, 18, r.choice((1, 1, 2, 3))))}</p>" + end for _ in range(r.randint(1, 4)))
            return a + head + body + b
        raise ValueError(kind)

    def prose(self) -> str:
        """A paragraph or other block of the article, at times with sloppy markup."""
        r = self.rng
        k = r.random()
        if k >= 0.05:
            text = self.block(True, 1, 20, r.choice((1, 1, 2, 3, 5, 8)))
        else:  # an article may itself speak of licences or privacy
            text = r.choice(("Copyright ", "All rights reserved. ", "Licensed under ", "Privacy and cookies: ", "© ")) + (self.words(0, 5) if r.random() < 0.7 else "")
            text = text.strip()
            if text in self.seen:
                text += " " + self.words(2, 4)
            self.seen.add(text)
            self.article.add(text)
        if k < 0.62:
            return f"<p>{self.inline(text)}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.7:
            return f"<p><b>{text}<br>"
        if k < 0.76:
            return f"<h{r.choice('234')}>{self.block(True, 1, 7)}</h2><p>{text}</p>"
        if k < 0.82:
            items = "".join(f"<li>{self.inline(self.block(True, 2, 14))}</li>" for _ in range(r.randint(2, 5)))
            return f"<p>{text}</p><{(t := r.choice(('ul', 'ol')))}>{items}</{t}>"
        if k < 0.87:
            return f"<blockquote><p>{text}</p></blockquote>"
        if k < 0.9:
            return f"<figure><img src=a.png><figcaption>{text}</figcaption></figure>"
        if k < 0.93:
            return f"<table><tr><td>{self.block(True, 1, 4)}</td><td>{text}</td></tr></table>"
        if k < 0.96:
            return f"<pre>{text}</pre>"
        return f"<div>{self.inline(text)}</div>"

    def story(self) -> str:
        r = self.rng
        a, b = r.choice((
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
            ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="entry">', "</div>"), ('<section class="story">', "</section>"),
            ('<div class="article-body">', "</div>"), ('<article class="post">', "</article>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"),
        ))
        head = f"<h1>{self.block(True, 2, 12)}</h1>" if r.random() < 0.85 else ""
        if head and a.startswith("<article") and r.random() < 0.2:
            head = f"<header>{head}</header>"
        body = []
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            body.append(self.prose())
            if r.random() < 0.06:
                body.append(self.part(r.choice(("ad", "side", "form", "notice"))))
        if r.random() < 0.1:
            body.append(self.part("comments"))
        return a + head + "".join(body) + b

    def html(self) -> str:
        r = self.rng
        some = lambda kinds, p: "".join(self.part(k) for k in kinds if r.random() < p)
        before = some(("notice",), 0.3) + some(("header",), 0.4) + some(("nav",), 0.8) + some(("form",), 0.15) + some(("ad",), 0.45) + some(("side",), 0.15)
        after = some(("ad",), 0.3) + some(("side",), 0.4) + some(("comments",), 0.4) + some(("form",), 0.25) + some(("nav",), 0.15) + some(("footer",), 0.85) + some(("notice",), 0.15)
        wrap = r.choice((("", ""), ("", ""), ('<div id="page" class="container">', "</div>"), ('<div class="wrapper">', "</div>")))
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{wrap[0]}{before}<!-- {self.word()} -->{self.story()}{after}<script>go();</script>{wrap[1]}{end}"


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """``n`` pages, each with the texts of its article blocks."""
    rng = random.Random(seed)
    for _ in range(n):
        page = _Page(rng)
        yield page.html(), page.article

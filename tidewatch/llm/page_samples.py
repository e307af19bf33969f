"""Labelled pages to learn main text from: pages put together at random from kinds of page parts, each with its label.

The words are invented per page and serve for article and surroundings alike, so that a model learns from the markup and the shape of texts
and not from words.  Labels are placed by a mark in front of main text that no page holds.
"""

from __future__ import annotations

import random
from typing import NamedTuple

MARK = "\ue000"  # of the private use area
SYLLABLES = "an be co da el fi go ha in jo ka lu ma no or pe qu ra sa te un vi wo xa ye zu th er re on st ing tion".split()


class Names(NamedTuple):
    """Names that page authors give to parts."""

    article: tuple[str, ...] = ("article-body", "entry-content", "post", "post-content", "story", "main-content", "content", "articleBody", "page-content", "blog-post", "text")
    nav: tuple[str, ...] = ("nav", "menu", "main-menu", "navbar", "site-navigation", "breadcrumbs", "topnav")
    head: tuple[str, ...] = ("header", "site-header", "masthead", "top-bar", "branding")
    foot: tuple[str, ...] = ("footer", "site-footer", "colophon", "bottom", "page-footer", "legal")
    side: tuple[str, ...] = ("sidebar", "side", "widget", "right-rail", "widget-area", "secondary")
    ad: tuple[str, ...] = ("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot", "advertisement")
    notice: tuple[str, ...] = ("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "gdpr")
    comments: tuple[str, ...] = ("comments", "comment-list", "reader-comments", "responses", "disqus_thread", "discussion")
    form: tuple[str, ...] = ("search", "newsletter", "login-form", "subscribe", "signup", "contact-form")
    share: tuple[str, ...] = ("share", "social", "share-buttons", "follow-us")
    more: tuple[str, ...] = ("related", "related-posts", "recommended", "popular", "read-more", "most-read")


NAMES = Names()


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(300)]

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def say(self, low: int, high: int) -> str:
        text = " ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))
        return text[0].upper() + text[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.say(2, 18) + self.rng.choice("...?!") for _ in range(self.rng.randint(low, high)))

    def tag(self, tag: str, names: tuple[str, ...], inside: str, named: float = 0.8) -> str:
        """An element that mostly has one of the names as class or id."""
        if not self.maybe(named):
            return f"<{tag}>{inside}</{tag}>"
        return f'<{tag} {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(names)}">{inside}</{tag}>'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.choice(self.words)}">{self.say(low, high)}</a>'

    def links(self, n: int, low: int = 1, high: int = 3) -> str:
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{self.link(low, high)}</li>" for _ in range(n)) + "</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(self.link(low, high) for _ in range(n))

    # parts around the article
    def nav(self) -> str:
        return self.tag(self.rng.choice(("nav", "nav", "div")), NAMES.nav, self.links(self.rng.randint(3, 9)))

    def header(self) -> str:
        inside = self.rng.choice((self.link(1, 2), f"<h1>{self.link(1, 3)}</h1>", f"<div>{self.say(1, 3)}</div><p>{self.say(3, 9)}</p>"))
        return self.tag(self.rng.choice(("header", "div")), NAMES.head, inside + (self.nav() if self.maybe(0.4) else ""))

    def footer(self) -> str:
        inside = self.rng.choice((f"&copy; {self.say(1, 3)} &middot; {self.say(3, 12)}.", f"<p>Copyright 2020 {self.say(1, 2)}. All rights reserved.</p>", f"<p>{self.sentences(1, 2)}</p>", self.say(2, 14) + "."))
        return self.tag(self.rng.choice(("footer", "footer", "div")), NAMES.foot, inside + (self.links(self.rng.randint(2, 6)) if self.maybe(0.5) else ""))

    def ad(self) -> str:
        inside = self.rng.choice((self.sentences(1, 2), self.link(3, 9), f"<p>{self.sentences(1, 2)}</p>", f"<h4>{self.say(2, 5)}</h4><p>{self.sentences(1, 1)}</p>{self.link()}"))
        return self.tag(self.rng.choice(("div", "div", "aside", "section")), NAMES.ad, inside, 1.0)

    def notice(self) -> str:
        text = self.rng.choice((f"We use cookies. {self.say(4, 12)}.", self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>"))
        return self.tag(self.rng.choice(("div", "div", "section", "aside", "dialog")), NAMES.notice, text + (f"<button>{self.say(1, 2)}</button>" if self.maybe(0.6) else ""), 1.0)

    def form(self) -> str:
        inside = f"<label>{self.say(1, 3)}</label><input type=text><button>{self.say(1, 2)}</button>"
        text = f"<p>{self.say(3, 12)}.</p>" if self.maybe(0.5) else f"<h3>{self.say(2, 5)}</h3>" if self.maybe(0.5) else ""
        options = "<select>" + "".join(f"<option>{self.say(1, 2)}</option>" for _ in range(3)) + "</select>" if self.maybe(0.3) else ""
        return self.tag("form", NAMES.form, text + inside + options, 0.7)

    def share(self) -> str:
        return self.tag("div", NAMES.share, self.rng.choice((self.links(3), "Share this: " + self.link(), f"<span>{self.say(1, 3)}</span>{self.link()}")), 0.9)

    def more(self) -> str:
        items = "".join(f"<div><h4>{self.link(3, 9)}</h4><p>{self.sentences(1, 2)}</p></div>" for _ in range(3)) if self.maybe(0.4) else self.links(self.rng.randint(3, 6), 3, 9)
        return self.tag(self.rng.choice(("div", "section", "aside")), NAMES.more, f"<h3>{self.say(1, 3)}</h3>" + items, 0.9)

    def sidebar(self) -> str:
        kinds = (self.more, self.ad, self.form, lambda: f"<h3>{self.say(1, 3)}</h3>" + self.links(5), lambda: f"<h3>{self.say(1, 3)}</h3><p>{self.sentences(1, 3)}</p>")
        inside = "".join(self.rng.choice(kinds)() for _ in range(self.rng.randint(1, 3)))
        tag = self.rng.choice(("aside", "div"))
        return self.tag(tag, NAMES.side, inside, 0.5 if tag == "aside" else 1.0)

    def comments(self) -> str:
        def one() -> str:
            by = self.rng.choice((f"<b>{self.say(1, 2)}</b>", f"<div>{self.say(1, 2)}</div>", f"<p>{self.say(1, 2)} wrote:</p>", ""))
            text = self.rng.choice((f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 2)}</p><p>{self.sentences(1, 3)}</p>", self.sentences(1, 3)))
            return by + text + (self.link(1, 1) if self.maybe(0.3) else "")

        tag = self.rng.choice(("li", "div", "article", "p"))
        entries = [f'<{tag} class="comment">{one()}</{tag}>' if self.maybe(0.5) else f"<{tag}>{one()}</{tag}>" for _ in range(self.rng.randint(1, 5))]
        inside = "<ol>" + "".join(entries) + "</ol>" if tag == "li" else "".join(entries)
        heading = f"<h3>{self.say(1, 3)}</h3>" if self.maybe(0.7) else ""
        return self.tag(self.rng.choice(("div", "section", "aside")), NAMES.comments, heading + inside + (self.form() if self.maybe(0.3) else ""), 1.0)

    # the article
    def main(self, text: str) -> str:
        return MARK + text

    def paragraph(self) -> str:
        text = self.main(self.sentences(1, 7) if self.maybe(0.85) else self.say(1, 6) + ".")
        if self.maybe(0.15):
            text += f" {self.link(1, 4)} {self.say(2, 6)}."
        if self.maybe(0.15):
            text = f"{MARK}<b>{text[1:]}</b>"
        return self.rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>")) if self.maybe(0.25) else f"<p>{text}</p>"

    def piece(self) -> str:
        roll = self.rng.random()
        if roll < 0.68:
            return self.paragraph()
        if roll < 0.78:
            level = self.rng.choice("234")
            return f"<h{level}>{self.main(self.say(1, 7))}</h{level}>"
        if roll < 0.86:
            tag = self.rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.main(self.say(2, 14))}</li>" for _ in range(self.rng.randint(2, 6))) + f"</{tag}>"
        if roll < 0.91:
            return f"<blockquote><p>{self.main(self.sentences(1, 3))}</p></blockquote>"
        if roll < 0.94:
            cells = lambda tag: "".join(f"<{tag}>{self.main(self.say(1, 3))}</{tag}>" for _ in range(3))
            return f"<table><tr>{cells('th')}</tr>" + "".join(f"<tr>{cells('td')}</tr>" for _ in range(2)) + "</table>"
        if roll < 0.97:
            return f"<figure><img src=x><figcaption>{self.main(self.say(3, 12))}</figcaption></figure>"
        return f"<pre>{self.main(self.say(3, 12))}</pre>"

    def article(self) -> str:
        title = f"<h1>{self.main(self.say(2, 10))}</h1>" if self.maybe(0.8) else f"<h2>{self.main(self.say(2, 10))}</h2>" if self.maybe(0.5) else ""
        if title and self.maybe(0.2):
            title = f"<header>{title}</header>"
        inside = [title]
        if self.maybe(0.12):  # a very short article
            short = self.main(self.say(1, 5) + ".")
            return title + self.rng.choice((f"<p>{short}</p>", f"<p><b>{short}<br>", f"<p>{short}"))
        for _ in range(self.rng.choice((1, 2, 3, 4, 6, 9, 14))):
            inside.append(self.piece())
            if self.maybe(0.12):
                inside.append(self.rng.choice((self.ad, self.share, self.more, self.notice))())
        if self.maybe(0.15):
            inside.append(self.share())
        if self.maybe(0.1):
            inside.append(self.comments())
        return "".join(inside)

    def page(self) -> str:
        tag = self.rng.choice(("article", "article", "article", "main", "div", "div", "section"))
        article = self.tag(tag, NAMES.article, self.article(), 0.9 if tag == "div" else 0.5)
        if self.maybe(0.3):
            article = self.rng.choice(("<main>{}</main>", '<div id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>', '<div id="content">{}</div>')).format(article)
        before = [part() for part, p in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.7), (self.form, 0.15), (self.ad, 0.4), (self.sidebar, 0.15)) if self.maybe(p)]
        after = [part() for part, p in ((self.share, 0.2), (self.ad, 0.25), (self.more, 0.25), (self.comments, 0.35), (self.sidebar, 0.3), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.8)) if self.maybe(p)]
        head = f"<title>{self.say(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>"
        end = "</body></html>" if self.maybe(0.8) else ""
        return f"<!DOCTYPE html><html><head>{head}</head><body>{''.join(before)}{article}{''.join(after)}{end}"


def labelled_pages(count: int = 400, seed: int = 20) -> list[str]:
    """``count`` pages whose main text is marked."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(count)]

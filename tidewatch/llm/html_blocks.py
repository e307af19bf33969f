"""Leaf blocks of an HTML page with the features of their ancestors and their text.

A block is the text between two boundaries of block-level elements; inline elements and line breaks do not end it.  White space
inside becomes one space and character references are decoded.  Missing end tags are supplied where HTML lets them be left out, end tags that close
nothing are skipped, contents of scripts, styles and the like are no text.  Time and memory are linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style title textarea template noembed noframes iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split()
)
SCOPES = frozenset("table td th caption button body html article section main aside nav".split())
# a start tag closes an open element of the first set, looked for up to one of the second
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
TAGS = frozenset(
    "nav footer header aside form article main section figure figcaption table ul ol dl blockquote pre button select noscript dialog address details menu label fieldset".split()
)
# what parts of class names, ids and roles say about an element
CONCEPTS = {
    "ad": ("advert", "sponsor", "promo", "banner", "adsense", "dfp", "commercial", "affiliate"),
    "nav": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "sitemap", "tabs", "skip"),
    "foot": ("foot", "copyright", "colophon", "legal", "contentinfo", "imprint"),
    "head": ("header", "masthead", "topbar", "branding", "logo", "tagline", "toolbar"),
    "side": ("sidebar", "aside", "widget", "rail", "complementary", "column2", "secondary"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "paywall", "warning", "dialog", "toast"),
    "comment": ("comment", "reply", "respond", "response", "disqus", "discussion", "feedback", "thread"),
    "form": ("form", "search", "login", "signup", "signin", "subscribe", "newsletter", "register", "contact"),
    "social": ("social", "share", "sharing", "follow", "twitter", "facebook"),
    "more": ("related", "recommend", "popular", "trending", "readmore", "also", "teaser", "latest", "outbrain", "taboola"),
    "meta": ("byline", "author", "meta", "tags", "category", "dateline", "timestamp"),
    "main": ("article", "content", "entry", "post", "story", "body", "main", "text", "prose", "blog"),
    "hidden": ("hidden", "invisible", "visually", "sronly"),
}
AD_WORDS = frozenset(["ad", "ads", "adv", "adbox", "adslot", "adunit", "adspace", "advertorial"])
PHRASES = re.compile(
    r"(?P<cookie>cookie|consent|gdpr)|(?P<subscribe>subscrib|newsletter|sign up|inbox)|(?P<login>log ?in|sign in|password|register)|(?P<share>\bshare\b|tweet|follow us|facebook|instagram)"
    r"|(?P<comment>comment|repl(?:y|ies))|(?P<advert>advert|sponsor)|(?P<more>read more|\bnext\b|previous|related|see also|back to top|most read)"
    r"|(?P<legal>privacy|terms|contact|about us|imprint|impressum|sitemap)|(?P<copyright>©|copyright|all rights)",
    re.I,
)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMED = frozenset(["class", "id", "role", "itemprop"])
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE: frozenset[str] = frozenset()


class Block(NamedTuple):
    text: str
    tag: str
    path: frozenset[str]  # features of all block-level ancestors
    near: frozenset[str]  # those of the nearest ancestor that says something
    parent: int  # number of the parent element of the leaf
    links: float  # share of the characters inside links


class _Element:
    __slots__ = ("tag", "path", "near", "number")

    def __init__(self, tag: str, path: frozenset[str], near: frozenset[str], number: int):
        self.tag, self.path, self.near, self.number = tag, path, near, number


_said: dict[tuple[str, str], frozenset[str]] = {}


def _says(tag: str, attributes: str) -> frozenset[str]:
    """Features of an element by its tag and its names."""
    found = _said.get((tag, attributes))
    if found is not None:
        return found
    features = {f"<{tag}"} if tag in TAGS else set()
    if attributes and tag not in ("body", "html"):
        hidden = re.search(r"""(?:^|\s)hidden(?=\s|$|=)|display:\s*none|aria-hidden\s*=\s*["']?true""", attributes) is not None
        names = " ".join(a or b or c for key, a, b, c in _ATTR.findall(attributes) if key.lower() in _NAMED)[:400]
        words = [w.lower() for w in _WORDS.findall(names)]
        joined = "".join(words)
        for concept, stems in CONCEPTS.items():
            if any(s in joined for s in stems):
                features.add(f".{concept}")
        if AD_WORDS.intersection(words):
            features.add(".ad")
        if hidden:
            features.add(".hidden")
    if len(_said) > 50_000:
        _said.clear()
    out = _said[tag, attributes] = frozenset(features)
    return out


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack = [_Element("html", _NONE, _NONE, 0)]
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked, made = 0, 0
    leaf: _Element | None = None
    parent = 0

    def flush() -> None:
        nonlocal linked, leaf
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, leaf.tag, leaf.path, leaf.near, parent, min(1.0, linked / len(text))))
            held.clear()
        linked, leaf = 0, None

    def say(text: str) -> None:
        nonlocal linked, leaf, parent
        if not text:
            return
        if leaf is None and not text.isspace():
            k = len(stack) - 1
            while k and stack[k].tag in INLINE:
                k -= 1
            leaf, parent = stack[k], stack[max(k - 1, 0)].number
        held.append(unescape(text))
        if open_tags["a"]:
            linked += len(text.strip())

    def pop(upto: int) -> None:
        while len(stack) > upto:
            gone = stack.pop()
            open_tags[gone.tag] -= 1
            if gone.tag not in INLINE:
                flush()

    at, size, last_end = 0, len(html), html.rfind(">")
    while at < size:
        mark = html.find("<", at)
        if mark < 0 or mark > last_end and not html.startswith("<!--", mark):
            say(html[at:])
            break
        found = _TOKEN.match(html, mark)
        if found is None:  # a bare "<"
            say(html[at : mark + 1])
            at = mark + 1
            continue
        say(html[at:mark])
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                pop(k)
            elif tag == "p" or tag not in INLINE:
                flush()
            continue
        if tag in HIDDEN_TEXT:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag not in INLINE:
            flush()
            if open_tags["p"] > 0:
                k = len(stack) - 1
                while k and stack[k].tag != "p" and stack[k].tag not in SCOPES:
                    k -= 1
                if stack[k].tag == "p":
                    pop(k)
            closes = CLOSES.get(tag)
            if closes and any(open_tags[t] > 0 for t in closes[0]):
                k = len(stack) - 1
                while k and stack[k].tag not in closes[0] and stack[k].tag not in closes[1]:
                    k -= 1
                if stack[k].tag in closes[0]:
                    pop(k)
        elif tag == "br":
            say(" ")
        elif tag == "a" and open_tags["a"] > 0:
            k = len(stack) - 1
            while k and stack[k].tag != "a" and stack[k].tag in INLINE:
                k -= 1
            if stack[k].tag == "a":
                pop(k)
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        above = stack[-1]
        own = _says(tag, attributes) if tag not in INLINE else _NONE
        if tag == "header" and ("<article" in above.path or "<main" in above.path):
            own = own - {"<header"} | {"<inner header"}
        made += 1
        path = above.path if own <= above.path else above.path | own
        stack.append(_Element(tag, path, own or above.near, made))
        open_tags[tag] += 1
    flush()
    return out


_SIZES = (1, 3, 7, 15, 30, 80)


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    for k, edge in enumerate(edges):
        if n <= edge:
            return k
    return len(edges)


def features(page: list[Block]) -> tuple[list[tuple[frozenset[str], frozenset[str], list[str]]], list[int]]:
    """Per block the features of its path, of the nearest telling ancestor and of its text; per block 1 if
    it has its predecessor's parent and telling ancestor."""
    words = [b.text.count(" ") + 1 for b in page]
    volume: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for b, n in zip(page, words):
        volume[b.parent] += n
        linked[b.parent] += n * b.links
    most = max(volume.values(), default=0)
    rows, same = [], []
    seen_h1 = False
    for k, (b, n) in enumerate(zip(page, words)):
        said = [f"tag={b.tag}", f"words={_bucket(n, _SIZES)}", f"links={_bucket(b.links, (0, 0.3, 0.7))}"]
        end = b.text[-1]
        said.append("sentence" if end in ".!?…\"”»。:;" else "open end")
        if n <= 40:
            said.extend({f"says {m.lastgroup}" for m in PHRASES.finditer(b.text)})
        total = volume[b.parent]
        said.append(f"around={_bucket(total, (10, 40, 120, 400))}")
        said.append(f"links around={_bucket(linked[b.parent] / total, (0, 0.3, 0.7))}")
        if total == most:
            said.append("largest")
        seen_h1 = seen_h1 or b.tag == "h1"
        said.append("after h1" if seen_h1 else "before h1")
        rows.append((b.path, b.near, said))
        same.append(int(k > 0 and b.parent == page[k - 1].parent and b.near == page[k - 1].near))
    return rows, same

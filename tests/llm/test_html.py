"""Main text: the given pages against their article element, hand-written pages, and the field against enumeration."""

import html as html_lib
import itertools
import math
import random
import re

import pytest

from tidewatch.llm import crf, html_extract, page_samples
from tidewatch.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars long, nth string, main string"


def article_of(html):
    """The given pages hold their main text as headings and paragraphs of one article element."""
    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = (" ".join(html_lib.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:h1|p)>", inside))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.url, article_of(r.html), len(article_of(r.html))) for r in pages.collect())
    assert sorted(tuple(r) for r in html_extract.extract(pages).collect()) == want


NEWS = """<!doctype html><HTML><head><title>Not text</title><style>p{}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body class="home"><div id="cookie-banner"><p>This site stores small files on your device.</p><button>Fine</button></div>
<header class="site-header"><a href="/">The Paper</a><nav><ul><li><a href=/a>World</a><li><a href=/b>Sport</a></ul></nav></header>
<div class="advert"><p>Buy our lamps, they burn for years.</p></div>
<div id=wrapper><div class="article-body"><h1>Harbour   reopens &amp; ships
 return</h1><p>The harbour opened on Monday after a long winter, and the first <a href=/x>ships</a> came in before noon.
<p>Captain Ilse Brandt said &ldquo;we waited&rdquo; for weeks&nbsp;at sea.<!-- <p>hidden</p> -->
<div class="ad-slot">Lamps are cheaper this week only.</div>
<h2>What comes next</h2><ul><li>Two piers will be mended.<li>A third one stays closed until spring.</ul>
<blockquote>Nobody here has seen ice like that, not even the oldest of the fishermen.</blockquote></div></div>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/c>A cat on a roof in town</a></li></ul></aside>
<section id="comments"><h3>3 comments</h3><article class="comment"><p>Anna</p><p>I was there and it was very cold, but what a sight it was.</p></article></section>
<form class="newsletter"><p>Get our news by post every morning.</p><label>Address</label><input><button>Send</button></form>
<footer>&copy; The Paper, Harbour Street 1. All rights reserved.</footer></body></html>"""


def test_hand_written_page():
    text = html_extract.Reader(html_extract.trained()).main_text(NEWS)
    assert text.split("\n") == [
        "Harbour reopens & ships return",
        "The harbour opened on Monday after a long winter, and the first ships came in before noon.",
        "Captain Ilse Brandt said “we waited” for weeks at sea.",
        "What comes next",
        "Two piers will be mended.",
        "A third one stays closed until spring.",
        "Nobody here has seen ice like that, not even the oldest of the fishermen.",
    ]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []), ("plain", ["plain"]), ("a < b and c > d", ["a < b and c > d"]), ("<p>one<p>two", ["one", "two"]), ("<p><b>x<br><p>y</p>", ["x", "y"]),
        ("<div>a<span>b</span> c<div>d</div>e</div>", ["ab c", "d", "e"]), ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("x<!-- y -->z<!-- open", ["xz"]), ("<script>a</p>b</script>c<style>d", ["c"]),
        ("<p title='>'>a</p><p title=\"<p>\">b</p>", ["a", "b"]), ("<p class='open>a</p>", ["a"]), ("&lt;p&gt; &amp;amp; &#233; &am &copy", ["<p> &amp; é &am ©"]),
        ("</p></div>a</i>b</div>c", ["ab", "c"]), ("<P>A\t\n B</P>", ["A B"]), ("<a>one<a>two</a>", ["onetwo"]), ("<h1>a<p>b", ["a", "b"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


def test_held_out_layouts():
    """Labelled pages that were not trained on."""
    reader = html_extract.Reader(html_extract.trained())
    right = total = 0
    for page in page_samples.labelled_pages(150, seed=99):
        truth = [int(b.text.startswith(page_samples.MARK)) for b in blocks(page)]
        found, labels = reader.read(page.replace(page_samples.MARK, ""))
        assert len(found) == len(truth)
        right += sum(a == b for a, b in zip(labels, truth))
        total += len(truth)
    assert right / total > 0.98


def test_awkward_rows(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    long = "<html><body><nav><a href=/>home</a></nav><article>" + "<p>A paragraph, and it says something.</p>" * 30_000 + "</article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", NEWS), (3, "u", NEWS), (3, "u", NEWS), (4, "u", deep), (5, "u", long), (6, "u", "<"), (7, "u", "<p" * 50_000), (8, "u", "</b>" * 50_000)]
    frame = spark.createDataFrame([(*r, "t", 1, "n", "m") for r in rows], SCHEMA).repartition(3)
    got = html_extract.extract(frame).collect()
    assert sorted(map(str, [(r.page_id, r.url) for r in got])) == sorted(map(str, [(p, u) for p, u, _ in rows]))
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == "" and text[None] == text[3] and text[5].count("\n") == 29_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    listed = html_extract.labelled_blocks(frame).filter("page_id = 3 AND nth = 0").collect()
    assert [(r.tag, r.main) for r in listed] == [("p", False)] * 2


def test_field_against_enumeration():
    rng = random.Random(4)
    model = crf.Model({}, [[[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)], [0.3, -0.2])
    for n in range(1, 9):
        scores, kinds = [rng.gauss(0, 1) for _ in range(n)], [rng.randrange(2) for _ in range(n)]

        def value(ys):
            return model.start[ys[0]] + sum(s * y for s, y in zip(scores, ys)) + sum(model.edges[k][a][b] for k, a, b in zip(kinds[1:], ys, ys[1:]))

        assert crf.viterbi(scores, kinds, model) == list(max(itertools.product((0, 1), repeat=n), key=value))


def test_training_reaches_the_likelihoods_maximum():
    """At the maximum without penalty the expected count of every feature is the one seen, by enumeration of all labellings."""
    data = [([["a"], ["b"], ["a", "b"]], [0, 0, 1], [1, 0, 1]), ([["a"], ["b"]], [0, 1], [0, 0]), ([["b"], ["a"], ["b"], ["a"]], [0, 1, 0, 1], [1, 1, 0, 1]), ([["a"]], [0], [0]), ([["b"], ["b"]], [0, 0], [1, 0]), ([["a"], ["a"]], [0, 1], [1, 1])]
    model = crf.fit(data, rounds=1500, rate=0.04, penalty=0.0)
    expected, seen = {"a": 0.0, "b": 0.0}, {"a": 0, "b": 0}
    for feats, kinds, labels in data:
        values = {}
        for ys in itertools.product((0, 1), repeat=len(feats)):
            v = model.start[ys[0]] + sum(model.edges[k][a][b] for k, a, b in zip(kinds[1:], ys, ys[1:]))
            values[ys] = math.exp(v + sum(model.weights[f] for fs, y in zip(feats, ys) if y for f in fs))
        for ys, v in values.items():
            for fs, y in zip(feats, ys):
                for f in fs:
                    expected[f] += y * v / sum(values.values())
        for fs, y in zip(feats, labels):
            for f in fs:
                seen[f] += y
    assert all(abs(expected[f] - seen[f]) < 0.05 for f in seen)

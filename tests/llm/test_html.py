import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from corpusloom.llm import html
from corpusloom.llm.queries import op1_html


class Inside(HTMLParser):
    """The blocks of a well-formed article: text between paragraph and heading tags."""

    def __init__(self):
        super().__init__()
        self.open, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.open |= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.open &= tag != "article"
        if tag in ("p", "h1"):
            self.parts.append("")

    def handle_data(self, data):
        if self.open:
            self.parts[-1] += data


def test_query_on_the_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op1_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    right = 0
    for r in rows:
        parser = Inside()
        parser.feed(pages[r["page_id"]]["html"])
        right += r["text"] == "\n\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
    assert right >= 0.99 * len(rows)


def test_held_out_layouts():
    rng, right, blocks = random.Random(77), 0, 0
    for _ in range(150):
        page, labels = html.labelled_page(rng)
        found = html.leaf_blocks(page)
        assert len(found.blocks) == len(labels)
        right += sum(a == b for a, b in zip(html.trained().labels(found), labels, strict=True))
        blocks += len(labels)
    assert right >= 0.98 * blocks


@pytest.mark.parametrize(("page", "want"), [
    ("<p>a &amp; b&nbsp;<b>c</b>\n d<br>e</p>", ["a & b c d e"]), ("<p>one<p>two<ul><li>x<li>y</ul>", ["one", "two", "x", "y"]),
    ("<script>var t='</p>';</script>t<style>p{}</style>", ["t"]), ("a<!-- <p>no</p> -->b", ["ab"]), ("<p title='>'>x</p", ["x"]), ("", []), (None, []),
    ("<td>1<td>2<tr><td>3", ["1", "2", "3"]), ("</div></p>x</b>", ["x"]), ("a < b and c > d", ["a < b and c > d"]), ("<p class=\"x>y</p>z", ["y", "z"]),
])
def test_leaf_blocks(page, want):
    assert [b.text for b in html.leaf_blocks(page).blocks] == want


@pytest.mark.parametrize(("page", "want"), [
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is", ["where x=2 is"]), ("<p>a <svg><text>label</text></svg> b</p><p>c", ["a label b", "c"]),
    ("<p>a <svg><path d='M0 0'/> b</p><p>c", ["a b", "c"]), ("<object data=x><p>no viewer: see <a href=y>y</a></p></object>z", ["no viewer: see y", "z"]),
    ("a<xmp><b>x</b> &amp; y</xmp>b", ["a", "<b>x</b> &amp; y", "b"]), ("a<xmp>b <p>c", ["a", "b <p>c"]), ("<p>a<math>b<p>c", ["ab", "c"]),
    ("<svg><style>p{}</style><title>t</title></svg>u", ["u"]),
])
def test_elements_that_hold_text_are_read(page, want):
    assert [b.text for b in html.leaf_blocks(page).blocks] == want


def test_other_layouts_of_one_article():
    body = "".join(f"<p>The report number {i} says that much has changed in the town since then.</p>" for i in range(4))
    main = "\n\n".join(["A town changes"] + [f"The report number {i} says that much has changed in the town since then." for i in range(4)])
    for page in (
        f'<body><div class="cookie-banner"><p>We use cookies</p></div><div class="post-content"><h1>A town changes</h1>{body}</div><div class="comments"><p>I do not agree with this report at all, it is wrong.</p></div></body>',
        f'<header><p>The daily page</p></header><main><h1>A town changes</h1>{body}<aside class="related"><p><a href="#">More of it</a></p></aside></main><form><p>Your email</p></form>',
        f"<nav><ul><li>Home<li>News</ul></nav><article><h1>A town changes</h1>{body}<section class='reader-comments'><p>So true, thanks.</p></section></article><footer>© us</footer>",
    ):
        assert html.main_text(page, html.trained()) == main


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(4)
    model = html.Model(rng.normal(size=(1 << html.BITS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    rows = [(1, 2), (3,), (4, 5, 6), (7,)]
    scores = model.scores(rows)
    total = {}
    for n in range(16):
        y = [n >> t & 1 for t in range(4)]
        total[tuple(y)] = model.first[y[0]] + sum(scores[t, y[t]] for t in range(4)) + sum(model.step[y[t], y[t + 1]] for t in range(3))
    assert tuple(model.viterbi(rows)) == max(total, key=total.get)
    weight = {y: np.exp(v) for y, v in total.items()}
    single, pairs = html._marginals(scores, model.step, model.first)
    for t in range(4):
        assert single[t, 1] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / sum(weight.values()))
    assert pairs[1, 0, 1] == pytest.approx(sum(w for y, w in weight.items() if y[1:3] == (0, 1)) / sum(weight.values()))


def test_odd_rows(spark):
    long = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>&#128512;</p>", None), (3, "u", long, "x"), (3, "u", long, "x"), (4, "u", "<" * 2000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract_main_text(pages).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert all(r["text"].count("\n\n") == 19_999 for r in got if r["page_id"] == 3)
    assert html.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div>x", "<div class='a{0}'>x", "<p><b>x</i>", "<ul><li>x</b>", "<a><section>x</p>", "</div>x<table><td>"])
def test_deep_pages_take_time_in_proportion(unit):
    began = time.time()
    found = html.leaf_blocks("".join(unit.format(k) for k in range(200_000 // 4)))
    assert len(found.blocks) >= 1 and sum(map(len, found.fresh)) <= 2 * 200_000
    html.trained().labels(found)
    assert time.time() - began < 30


def test_scores_of_nodes_equal_scores_of_rows():
    rng, model = random.Random(12), html.trained()
    for _ in range(20):
        found = html.leaf_blocks(html.labelled_page(rng)[0] + "<div class='nav nav'><p class=menu>a<nav>b")
        assert all(len(set(r)) == len(r) for r in html.features(found))
        assert np.allclose(model.page_scores(found), model.scores(html.features(found)))

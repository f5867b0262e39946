from __future__ import annotations

import html
import re

import numpy as np
import pytest

from shelfwise.llm import html_text

from .conftest import SF


def article(page):
    """The article of the plain page form of the tables, by pattern."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_table_held_out(spark):
    """Trained on 20 pages, right on all others."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r["page_id"]: r for r in pages.collect()}
    rows = html_text.extract(pages, sample=20).collect()
    assert len(rows) == len(sources)
    for r in rows:
        assert r["text"] == article(sources[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == sources[r["page_id"]]["url"]


@pytest.fixture(scope="module")
def field(spark):
    return html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


BODY = ["A first paragraph that says a good deal about its subject.", "A second one, no shorter than the first was."]


@pytest.mark.parametrize(
    "page",
    [
        "<header>Site name</header><main><p>{}</p><p>{}</p></main><footer>(c) site</footer>",
        "<div id=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"
        "<div class='post'><p>{}<p>{}</div><div class='sidebar'><p>More stories here.</p></div>",
        "<article><p>{}</p><aside>Related: other</aside><p>{}</p>"
        "<section class='comments'><p>What a good text this was, I liked to read it.</p></section></article>",
        "<div class='cookie-notice'>We use cookies.</div><article><div>{}</div><div>{}</div>"
        "<form><label>Mail</label><input name=x><button>Send</button></form></article>",
    ],
)
def test_other_page_forms(field, page):
    assert html_text.main_text("<html><body>" + page.format(*BODY) + "</body></html>", field) == " ".join(BODY)


LONG = [*BODY, "The third goes on for a while, as a paragraph of an article does, and then it ends.", "A fourth one closes it."]


@pytest.mark.parametrize("body", [LONG, LONG * 5])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='wrap7'>{}</div>", "<div>{}</div>", "<main>{}</main>"])
@pytest.mark.parametrize(
    "extra",
    [
        "<div class='recommendations'><p>Ten more things to read.</p><p><a href=/x>Another text of ours</a></p></div>",
        "<div class='toolbar'><span>Print</span> <span>Save</span></div>",
        "<div class='gdpr'><p>We value what you keep to yourself.</p><p>Agree</p></div>",
        "<section id='disqus'><div>I do not think so at all.</div><div>Nor do I, but who asks.</div></section>",
        "<div class='responses'><p>What a good text this was, I liked to read it.</p><p>So did I.</p></div>",
        "<table class='tabs'><tr><td><a href=/a>Home</a></td><td><a href=/b>News</a></td><td><a href=/c>Sport</a></td></tr></table>",
    ],
)
def test_names_not_met_in_training(field, extra, around, body):
    """Parts whose class says nothing to the field are told by their place, before and after the article."""
    text = around.format("".join(f"<p>{p}</p>" for p in body))
    for page in (extra + text, text + extra):
        assert html_text.main_text(f"<html><body>{page}</body></html>", field) == " ".join(body)


def test_tags_of_both_sides_stay_in_the_article(field):
    inner = f"<h2>On a thing</h2><p>{LONG[0]}</p><blockquote>{LONG[1]}</blockquote><ul><li>{LONG[2]}</li></ul><pre>{LONG[3]}</pre>"
    got = html_text.main_text(f"<html><body><nav><p>Home</p></nav><article>{inner}</article></body></html>", field)
    assert got == " ".join(["On a thing", *LONG])


def test_blocks_of_broken_pages():
    read = lambda page: [b.text for b in html_text.blocks(page)]
    assert read("<p>a <b>b</b>&amp;\n c<br>d<p>e</div>f") == ["a b& c d", "e", "f"]
    assert read("<script>var t='<p>x</p>';</script>x<style>p{}</style><!-- <p>no</p> -->y") == ["x", "y"]
    assert read("<a title='1 > 0'>k</a><div data-x=\"</div>\">m") == ["k", "m"]
    assert read("") == [] and read("<script>never closed") == [] and read("1 < 2 & 3") == ["1 < 2 & 3"]


def test_marginals_and_viterbi_equal_enumeration():
    field = html_text.Field()
    rng = np.random.default_rng(1)
    field.names = {"a": 0, "b": 1, "c": 2}
    field.weights, field.moves = rng.normal(size=3), rng.normal(size=(2, 2))
    page = [["a"], ["b", "c"], ["c"], ["a", "b"], ["b"]]
    scores = field._scores([[field.names[f] for f in own] for own in page])
    paths = [[i >> k & 1 for k in range(5)] for i in range(32)]
    value = [sum(s * y for s, y in zip(scores, p, strict=True)) + sum(field.moves[x, y] for x, y in zip(p, p[1:])) for p in paths]
    chance = np.exp(value) / np.exp(value).sum()
    content, _ = field._marginals(scores)
    assert content == pytest.approx((chance[:, None] * np.array(paths)).sum(0))
    assert field.decode(page) == paths[int(np.argmax(value))]


def test_odd_rows(spark):
    long = "<article>" + "<p>word word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", long, "x"), (4, "u", long, "y"), (4, "u", long, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 219_999), (1, 0), (2, 0), (4, 219_999), (4, 219_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "tag", ['<svg class="icon"/>', "<svg/>", '<svg viewBox="0 0 1 1" />', "<svg>", "<select>", "<iframe src='x'>", "<noscript>", "<template>"]
)
def test_a_tag_without_an_end_takes_nothing_along(tag):
    assert [b.text for b in html_text.blocks(f"<p>one</p>{tag}<article><p>two</p></article>{tag}<p>three")] == ["one", "two", "three"]
    closed = "<svg><path d='M0'/>gone</svg>"
    assert [b.text for b in html_text.blocks(f"<p>one</p><svg />two{closed}<p>three")] == ["one", "two", "three"]
    assert [b.text for b in html_text.blocks("<p>one</p><script>x = '<p>two</p>'")] == ["one"]

"""Main text of pages."""

from __future__ import annotations

import html
import random
import re
import time

import duckdb
import pytest

from lodestone.llm import html as H

LONG = "This is a sentence that has a number of the usual words in it, as it should for the test of the rules. " * 3


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        ("<nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>Short.<p>One &amp; two&nbsp;three<br>four</article><footer>f</footer>", "Title\nShort.\nOne & two three\nfour"),
        ("<article>a<script>x<p>y</script><style>p{}</style>b<!-- <p>c --><b>d</b>e</article>", "abde"),
        ("<article><p>x<div class='ad'>Buy</div><p>y<aside>z</aside><form><input value=1>q</form></article>", "x\ny"),
        ("<article><p>x</p><section class='comments'><p>reader</p></section><div id=cookie-notice>n</div></article>", "x"),
        ("<article><p>a  \n\t b</p><ul><li><a href=q>link one</a></li></ul></article>", "a b"),
        ("<article><p>5 &lt; 6 &copy &#233; &unknown; <p title='a>b'>q</p>", "5 < 6 © é &unknown;\nq"),
        (f"<div>{LONG}</div><div>Ab.</div><div>{LONG}</div><div><a href=x>{LONG}</a></div>", f"{LONG.strip()}\nAb.\n{LONG.strip()}"),
        ("<div>tiny</div>", ""),
        ("<p hidden>gone<p>", ""),
        (f"<div role=navigation>{LONG}</div><main><p>kept</p></main>", "kept"),
    ],
)
def test_pages(body, text):
    assert H.main_text(page(body)) == text


def test_null_empty_broken_and_long():
    assert H.main_text(None) == H.main_text("") == H.main_text("<") == H.main_text("<article>") == ""
    assert H.main_text("<article><p>open") == "open"
    assert H.main_text("<article>a<script>never closed") == "a"
    big = "<article>" + "<p>word word</p>" * 50_000 + "<div>" * 2000 + "deep"
    assert H.main_text(big).count("\n") == 50_000
    assert H.main_text("<article>" + "<a " * 5000) == ""


@pytest.mark.parametrize("stray", ["<b></i>", "</div>", "<p></b>", "<div><p>x</a>", "<b '>", "<a <", "</", "<!-", "<td></li>"])
def test_broken_pages_take_time_in_proportion(stray):
    began = time.process_time()
    H.main_text("<article>" + stray * 200_000)
    assert time.process_time() - began < 20


def slow_labels(blocks, rules):
    """The second pass, block by block, looking out on both sides."""
    away = H.foreign([(b, b.text()) for b in blocks], rules)
    first = [H.decide(b, b.text(), rules, away) for b in blocks]
    tells = [x is not None and not b.furniture and (x or not b.article) for b, x in zip(blocks, first, strict=True)]
    out = []
    for i, (b, x) in enumerate(zip(blocks, first, strict=True)):
        if x is None:
            sides = [next((first[j] for j in side if blocks[j].article == b.article and tells[j]), None) for side in (range(i - 1, -1, -1), range(i + 1, len(blocks)))]
            told = [s for s in sides if s is not None]
            x = all(told) if told and len(set(told)) == 1 else b.article > 0
        out.append(x)
    inside = any(x and b.article for b, x in zip(blocks, out, strict=True))
    return [x and (b.article > 0 or not inside) for b, x in zip(blocks, out, strict=True)]


def test_second_pass_against_brute_force():
    rng = random.Random(5)
    pieces = [f"<p>{LONG}</p>", "<p>Ab.</p>", "<p>" + "xylo quartz " * 9 + "</p>", f"<p><a href=x>{LONG}</a></p>", "<p>of the night in May and the day</p>", "<article>", "</article>", "<nav>go</nav>", "<li>the one</li>", "<main>", "</main>", "<p>" + "the zebra quagga " * 8 + "</p>"]
    for _ in range(400):
        text = page("".join(rng.choices(pieces, k=rng.randint(1, 14))))
        found = [b for b in H.blocks(text) if b.text()]
        expected = "\n".join(b.text() for b, x in zip(found, slow_labels(found, H.Rules()), strict=True) if x)
        assert H.main_text(text) == expected


def test_all_given_pages(spark):
    """The given pages have one article each, whose blocks can be cut out directly."""
    data = "/root/testdata/sf0.01"
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{data}/pages.parquet'").fetchall())
    for r in H.op7_html(spark, data).collect():
        part = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", part)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_columns(spark):
    got = spark.createDataFrame([(1, None), (1, None), (2, "<article>a</article>")], "page_id long, html string").select("page_id", H.extract(H.F.col("html")).alias("text")).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (1, ""), (2, "a")]


PLAIN = "The council met on Monday to talk about the new bridge and its cost for the town, which will be paid by the state."


@pytest.mark.parametrize(
    "body",
    [
        f"<article><div style='overflow:hidden'><p>{PLAIN}</p></div></article>",
        f"<article><div data-hidden='false'><p>{PLAIN}</p></div></article>",
        f"<article><div data-id='sidebar'><p>{PLAIN}</p></div></article>",
        f"<article><p title='class = header'>{PLAIN}</p></article>",
        f"<article><p title=\"x class='ad' hidden id=menu\">{PLAIN}</p></article>",
        f"<article class='has-sidebar'><div class='article-header'><p>{PLAIN}</p></div></article>",
        f"<div class='page has-sidebar no-footer'><p>{PLAIN}</p></div>",
        f"<article><div class='main-menu-story headline'></div><p class='shadow adorned'>{PLAIN}</p></article>",
        f"<article><p onclick='hide()' data-role=navigation>{PLAIN}</p></article>",
    ],
)
def test_ordinary_attributes_cost_no_text(body):
    assert H.main_text(page(body)) == PLAIN


@pytest.mark.parametrize("tag", ["div class=site-footer", "div class='x y ad-slot'", "div id=nav", "div class=post-comments", "div class=cookie_banner", "div ROLE='Navigation'", "div hidden=''", "div aria-hidden = 'true'", "div class='&#97;d'", "section class=article-related"])
def test_furniture_by_name(tag):
    assert H.main_text(page(f"<article><p>{PLAIN}</p><{tag}><p>{PLAIN}</p></div></section></article>")) == PLAIN


def test_attributes():
    assert H.attributes(" class = 'a b' ID=x hidden data-class=\"c\" Class=z href=/a/b?c=d 'stray' =") == {"class": "a b", "id": "x", "hidden": "", "data-class": "c", "href": "/a/b?c=d"}


@pytest.mark.parametrize("text", ["Совет собрался в понедельник, чтобы обсудить новый мост и его стоимость. " * 4, "市议会周一开会讨论新桥及其费用。" * 8, "Il consiglio si riunisce oggi, discute il nuovo ponte, costi, tempi, pareri, cittadini, imprese. " * 4])
def test_languages_that_the_stop_words_do_not_cover(text):
    text = text.strip()
    links = "<div><a href=a>Uno</a> <a href=b>Due</a> <a href=c>Tre</a></div>"
    assert H.main_text(page(f"{links}<div>{text}</div><div>{text}</div>{links}")) == f"{text}\n{text}"


#: A page without an article element, its furniture unmarked: what is dropped and kept is for the two passes to say.
UNMARKED = page(
    "<div><a href=a>Home</a> <a href=b>News</a> <a href=c>Sport</a></div>"
    "<div>Weather maps, station lists, tide tables, road reports, ferry times, market prices, flight boards, radio plans</div>"
    f"<div>By A. Writer</div><div>{LONG}</div><div>Photo: archive</div><div>{LONG}</div>"
    "<div>Imprint, terms, contact, careers, licences, partners, awards, archives, sitemap, accessibility, mirrors, feeds</div>"
    "<div>Reg. no. 12345</div>"
)


def test_both_passes_decide(monkeypatch):
    kept = f"{LONG.strip()}\nPhoto: archive\n{LONG.strip()}"
    assert H.main_text(UNMARKED) == kept
    # Without density (no stop words) the lists of services are kept, or all is judged by length.
    with monkeypatch.context() as m:
        m.setattr(H, "STOP_WORDS", frozenset())
        assert H.main_text(UNMARKED) != kept
    # Without link density the links are text.
    assert H.main_text(UNMARKED, H.Rules(links=2.0, short=10)) != kept
    # Without the second pass what is short is lost, or all kept.
    first = H.decide
    for label in (True, False):
        with monkeypatch.context() as m:
            m.setattr(H, "decide", lambda *a, label=label: label if (x := first(*a)) is None else x)
            assert H.main_text(UNMARKED) != kept

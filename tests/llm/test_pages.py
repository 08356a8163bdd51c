"""Extraction of main texts: planted pages, the given pages against their own article, odd rows."""

import html
import random
import re
import time

import pytest

from seqloom.llm.text_density import content, densities, extracted, main_text, op11_text_density, Page

LONG = "The council met on Tuesday and agreed, after some hours, that the old bridge would be mended before the winter sets in."
MORE = "Its stones were laid two hundred years ago, and nobody in the town remembers a year in which it had been closed before."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(12)) + "</ul>"

PAGES = {
    "plain": (f"<body><p>{LONG}</p><p>{MORE}</p></body>", f"{LONG}\n{MORE}"),
    "menus": (
        f"<html><head><title>no</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav>{MENU}</nav>"
        f"<div id=page><div class='side-bar sidebar'>{MENU}</div><div class=text><h1>The old bridge</h1><p>{LONG}<p>{MORE}</div></div>"
        f"<form><label>Mail</label><input value=x><button>Go</button></form><footer>&copy; all</footer>",
        f"The old bridge\n{LONG}\n{MORE}",
    ),
    "unnamed menu": (f"<div>{MENU}</div><div><p>{LONG}</p><p>{MORE}</p><p>{LONG} Yes.</p></div>", f"{LONG}\n{MORE}\n{LONG} Yes."),
    "comments": (
        f"<article><h2>Bridge</h2><p>{LONG}</p><div class='comments'><p>{MORE} First!</p><p>{MORE} Second!</p></div><p>Short.</p></article>"
        f"<article class=comment><p>{MORE}</p></article><section id='comments'><article><p>{LONG}</p></article></section>",
        f"Bridge\n{LONG}\nShort.",
    ),
    "references": (f"<p>A &amp; B &lt;i&gt; &eacute;&#233;&#xe9; &nbsp; x&nbsp;y &bogus; {LONG}</p>", f"A & B <i> ééé x y &bogus; {LONG}"),
    "white space": (f"<p>\n  {LONG}\t\t<b>bold\n</b> end<br>line </p>\n<ul><li>one<li>two {MORE}</ul>", f"{LONG} bold end line\none\ntwo {MORE}"),
    "scripts": (f"<script>var p = '<p>no</p>'; if (a<b) {{}}</script><p>{LONG}<!-- <p>no</p> --></p><noscript>no</noscript><p>{MORE}</p>", f"{LONG}\n{MORE}"),
    "quoted tags": (f'<p title="a > b">{LONG}</p><p data-x=\'"\'>{MORE}</p>', f"{LONG}\n{MORE}"),
    "hidden": (f"<main><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div><p aria-hidden=true>no</p><p>{LONG}</p></main>", LONG),
    "wide main": (f"<main><div><p>{LONG}</p><p>{MORE}</p></div><p>Tail.</p></main>", f"{LONG}\n{MORE}\nTail."),
    "stopped": (f"<article><p>{LONG}</p><p>{MORE} <a href='x", f"{LONG}\n{MORE}"),
    "open comment": (f"<p>{LONG}<!-- {MORE}", LONG),
    "head left open": (f"<head><title>no</title><p>{LONG}", LONG),
    "inline ends": (f"<article><i><p>{LONG}</i> still here</p></article>", f"{LONG} still here"),
    "article header": (f"<article><header class=entry-header><h1>Kept</h1></header><p>{LONG}</p><footer>no</footer></article>", f"Kept\n{LONG}"),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<body><nav><a>menu</a></nav></body>", ""),
    "no markup": (f"{LONG}  {MORE}", f"{LONG} {MORE}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_planted_pages(name):
    source, wanted = PAGES[name]
    assert main_text(source) == wanted


def test_density_sums_by_hand():
    page = Page("<div><p>aaaa</p><p>bb<a>cc</a></p></div>")
    density, sums = densities(page)
    assert page.tag == ["body", "div", "p", "p", "a"]
    assert sums[1] == pytest.approx(density[2] + density[3])
    assert density[2] > density[3] > 0 and content(page)[1]


def test_long_and_broken_pages_take_linear_time():
    draw = random.Random(3)
    tags = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<a href='x'>", "</a>", "word ", "&amp;", "<td>", "<table>", '<x "']
    for source in ("<div>" * 100_000 + LONG, "<b>" * 100_000 + "</i>" * 100_000 + LONG, "<a " * 200_000, "<!--" * 100_000, "<p><b>" * 60_000 + "x" + "</b></p>" * 60_000, "".join(draw.choices(tags, k=200_000))):
        begun = time.perf_counter()
        main_text(source)
        assert time.perf_counter() - begun < 30


def test_rows_and_columns(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGES["menus"][0], "clash", "x"), (1, "u", PAGES["menus"][0], "clash", "x"), (None, None, None, None, None), (3, "v", "", "", "")]
    made = extracted(spark.createDataFrame(rows, schema))
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    wanted = PAGES["menus"][1]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([(1, "u", wanted, len(wanted))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=repr)
    assert extracted(spark.createDataFrame([], schema)).count() == 0


def test_given_pages_give_their_article(spark):
    folder = "/root/testdata/sf0.001"
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in op11_text_density(spark, folder).collect():
        body = re.search("<article>(.*?)</article>", sources[row["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>|<br>", "", part)).split()) for part in re.split("</?(?:p|h1)>", body))
        assert row["text"] == "\n".join(p for p in parts if p) and row["n_chars"] == len(row["text"])

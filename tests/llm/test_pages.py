"""Main text of varied pages whose text is known."""

import re

import pytest

from kindred.llm import html_text

TITLE = "How the old mill was mended"
PARAS = [
    "The mill had stood empty for thirty years when the two sisters bought it from the town.",
    "They found the wheel broken, the roof open to the sky and the floor gone in most of the rooms.",
    "Short one.",
    "It took four summers, but in the end the stones turned again and the first flour was sold at the market.",
]
WANT = "\n".join([TITLE, *PARAS])
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}</p>" for p in PARAS)
PLAIN = f"<h1>{TITLE}</h1>" + "".join(f"<div>{p}</div>" for p in PARAS)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">All the news</a></li></ul></nav>'
FOOT = "<footer><p>All rights are reserved by the publisher of this paper.</p><a href='/i'>Imprint</a></footer>"
SIDE = "<aside><h3>Most read</h3><ul><li><a href='/1'>A storm came over the hills last night</a></li></ul></aside>"

PAGES = {
    "article": f"{NAV}<article>{BODY}</article>{SIDE}{FOOT}",
    "main": f"<header><h1>The Daily Paper</h1></header>{NAV}<main>{BODY}</main>{FOOT}",
    "class content": f'{NAV}<div class="content no-sidebar">{BODY}</div>{FOOT}',
    "entry header": f'<article class="post has-sidebar"><div class="entry-header"><h1>{TITLE}</h1></div>{BODY.split("</h1>")[1]}</article>{FOOT}',
    "header in article": f'<article><header class="post-header"><h1>{TITLE}</h1></header>{BODY.split("</h1>")[1]}</article>',
    "overflow hidden": f'<div style="overflow: hidden">{BODY}</div>{FOOT}',
    "word hidden": f'<div class="page" title="a hidden gem">{BODY}</div>{NAV}',
    "hidden attribute": f"{NAV}<article>{BODY}<p hidden>This is not to be seen by anyone at all, it says.</p></article>",
    "not displayed": f'<article>{BODY}<div style="display:none">This is not to be seen by anyone at all, it says.</div></article>',
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies to make this page better for all of you.</p></div><article>{BODY}</article>',
    "advert inside": f'<article><h1>{TITLE}</h1>{"".join(f"<p>{p}</p>" for p in PARAS[:2])}<div class="ad-slot">Buy this fine new car today. It is cheap.</div>{"".join(f"<p>{p}</p>" for p in PARAS[2:])}</article>',
    "comments": f'<article>{BODY}</article><section id="comments"><article class="comment"><p>I liked this a lot, my uncle had a mill just like it.</p></article></section>',
    "post comments": f'<article>{BODY}<div class="post-comments"><p>I liked this a lot, my uncle had a mill just like it.</p></div></article>',
    "no end tags": f"<body>{NAV}<article><h1>{TITLE}</h1>" + "".join(f"<p>{p}\n" for p in PARAS),
    "upper case": f"<BODY>{NAV}<ARTICLE>{BODY.replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY>",
    "divs only": f'<div id="site-header"><a href="/">The Daily Paper</a></div><div id="story">{PLAIN}</div><div id="site-footer">All rights are reserved by the publisher.</div>',
    "table": f"<table><tr><td>{NAV}</td><td>{BODY}</td></tr></table>{FOOT}",
    "scripts": f"<head><title>No</title><style>p{{}}</style></head><article>{BODY}<script>if (a < b) document.write('<p>No</p>');</script><noscript>Please turn on scripts to see it.</noscript></article>",
    "form": f"<article>{BODY}</article><form><label>Your name</label><input><button>Send it now</button></form>",
    "camel case": f'<div class="mainNav"><a href="/">Home is here</a></div><div class="storyBody">{PLAIN}</div><div class="relatedPosts"><a href="/2">Another mill was sold</a></div>',
    "share row": f'<article>{BODY}<div class="share-buttons"><a href="#">Share this with your friends</a></div></article>',
    "open quote": f"<article>{BODY}</article><p><a href='/x>odd</a>",
    "references": f"<article>{BODY.replace('the two', 'the&#32;&#x74;wo').replace('they', 'th&#101;y')}</article>{FOOT}",
    "white space": "<article>\n\t" + re.sub(r" ", " \n\t ", BODY.replace("<h1>", "<h1> ").replace("</p>", " </p>\n")) + "</article>",
    "links in text": f"{NAV}<article>{BODY.replace('the town', '<a href=x>the town</a>').replace('four summers', '<em>four</em> <b>summers</b>')}</article>",
}


@pytest.mark.parametrize("kind", PAGES)
def test_main_text_of(kind):
    got = html_text.main_text(PAGES[kind]).split("\n")
    if kind == "open quote":
        got = [line for line in got if line != "odd"]
    assert got == WANT.split("\n")


def test_edges_of_references_tags_and_nothing():
    assert html_text.main_text("<article><p>&am<b>p;lt;</b> is what the page says here, and &amp;lt; too.</p></article>") == "&amp;lt; is what the page says here, and &lt; too."
    assert html_text.main_text('<article><p>Some words and <a href="x>link</a> more words that follow.</p></article>') == "Some words and link more words that follow."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<", "<!--", "</p></div>", "<nav>Home and away</nav>")] == ["", "", "", "<" if html_text.main_text("<") else "", "", "", ""]


def test_repeated_rows_ties_and_clashing_columns(spark):
    rows = [(1, "u", PAGES["main"], "x"), (1, "u", PAGES["main"], "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0
    # Of several smallest cuts, that with the most content: a block of score 0 beside content is content.
    assert html_text.minimum_cut([2.0, 0.0, 0.0], [(0, 1, 1.0), (1, 2, 1.0)]) == [True, True, True]

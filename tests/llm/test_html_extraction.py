"""Extraction on pages whose main text is known."""

import os
import re

import pytest

from tidewatch.llm import html_extraction as extraction
from tidewatch.llm import queries

FOLDER = "/root/testdata/sf0.01"
PARAGRAPH = "A sentence with some length, a comma or two, and words that go on for a while so that it counts."


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>one<p>two &amp; three", "one\ntwo & three"),
    ("<nav><a href=x>Home</a></nav>", ""), ("<ul><li><a href=a>a</a><li><a href=b>b</a></ul>", ""),
    (f"<body><div class=menu>m</div><div id=content><h1>T</h1><p>{PARAGRAPH}</p><p>Short.</p></div><div class='sidebar'><p>{PARAGRAPH}</p></div></body>",
     f"T\n{PARAGRAPH}\nShort."),
    (f"<article><header><h1>Title</h1></header><p>{PARAGRAPH}<br>next&nbsp;line</p><div class=ad>Buy, buy, buy</div><pre>a\n  b</pre>"
     f"<section class='comments'><p>{PARAGRAPH}</p></section><footer>f</footer></article><footer>g</footer>", f"Title\n{PARAGRAPH} next line\na b"),
    (f"<main><div><p>{PARAGRAPH}</p></div><div><p>Ok.</p></div><table><tr><td>1<td>2<tr><td>3</table></main>", f"{PARAGRAPH}\nOk.\n1\n2\n3"),
    (f"<div><p>{PARAGRAPH}</p><script>var t='</p><p>no'; if (a<b) c()</script><style>p{{}}</style><!-- <p>no</p> --><form><p>{PARAGRAPH}</p></form></div>", PARAGRAPH),
    (f"<body class='has-sidebar'><h1>Head</h1><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><aside>{PARAGRAPH}</aside></body>",
     f"Head\n{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<div role=navigation>{PARAGRAPH}</div><div class='cookie-notice'>{PARAGRAPH}</div><div><p>a<b>b</b>c {PARAGRAPH} &#8212;&eacute;</p></div>",
     f"abc {PARAGRAPH} —é"),
    (f"<article class='comment'>{PARAGRAPH}</article><article><p>{PARAGRAPH}!</p></article>", f"{PARAGRAPH}!"),
    (f"<div id=post><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><p>Short, too.</p></div></div>", f"{PARAGRAPH}\n{PARAGRAPH}\nShort, too."),
    (f"<body><section><p>{PARAGRAPH}</p></section><ul><li>one<li>two</ul><table><tr><td>3</table><section>last</section>bare</body>",
     f"{PARAGRAPH}\none\ntwo\n3\nlast\nbare"),
    (f"<body><div><p>{PARAGRAPH}</p></div><ul><li><a href=a>x</a><li><a href=b>y</a></ul></body>", PARAGRAPH),
    (f"<body><form action=x><div><p>{PARAGRAPH}</p></div><input name=q><select><option>o</select></form></body>", PARAGRAPH),
    (f"<body><form><p>Name</p></form><div><p>{PARAGRAPH}</p></div></body>", PARAGRAPH),
    (f"<body><div class='copyright-law'><p>{PARAGRAPH}</p></div><div class=copyright>(c) 2020</div></body>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH} <label>kept</label> <math><mi>x</mi></math></p></article>", f"{PARAGRAPH} kept x"),
    (f"<article><p>{PARAGRAPH}</p><div class='comments has-replies'><p>{PARAGRAPH}!</p></div><div id=reader-responses><p>no</p></div></article>", PARAGRAPH),
    (f"<body><div class='with-comments'><p>{PARAGRAPH}</p></div></body>", PARAGRAPH),
    ("<p>a < b and <unclosed 'x", "a < b and"), ("<div><p>x</div></p></span>y", "x\ny"),
])
def test_pages(page, want):
    assert extraction.main_text(page) == want


def test_hostile_pages():
    assert extraction.main_text("<div>" * 50_000 + PARAGRAPH) == PARAGRAPH
    assert extraction.main_text("</div>" * 50_000 + f"<p>{PARAGRAPH}") == PARAGRAPH
    assert extraction.main_text(f"<p>{PARAGRAPH}</p>" * 20_000).count("\n") == 19_999


def test_frame(spark):
    rows = [(1, "u", f"<p>{PARAGRAPH}</p>", 1), (1, "u", f"<p>{PARAGRAPH}</p>", 1), (None, None, None, 2), (3, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extraction.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", PARAGRAPH, len(PARAGRAPH))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extraction.extract(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_given_pages(spark):
    """The given pages have one article element; what it says is known by plain means."""
    import html

    source = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for row in queries.QUERIES["op7_html_extraction"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*)</article>", source[row.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert row.text == "\n".join(filter(None, blocks)) and row.n_chars == len(row.text)

import glob

import pyarrow.parquet as pq
import pytest

from tidewatch.llm.html import extract, extract_main_text

BODY = "<h1>A title</h1><p>First paragraph, with commas, and some length to it, for sure.</p><p>Second &amp; last&nbsp;one,\n  folded &#233;.</p>"
WANT = "A title\nFirst paragraph, with commas, and some length to it, for sure.\nSecond & last one, folded é."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=/a>a</a></li></ul></nav><article>{BODY}</article><footer>foot, foot, foot and more foot</footer></body></html>",
        f"<body><header><h2>Site</h2><p>Slogan, slogan, slogan, slogan, slogan.</p></header><main>{BODY}</main><aside><p>Side, side, side, side.</p></aside></body>",
        f"<div class='wrapper has-menu'><div id='sidebar'><p>Side, side, side, side, side, side.</p></div><div id='content'>{BODY}</div></div>",
        f"<div id=cookie-notice><p>We use cookies, and more, and more, and more of them.</p></div><article>{BODY}<div class='ad'>Buy, buy</div></article>",
        f"<article>{BODY}<script>var x = '</p><p>no</p>';</script><style>p{{}}</style><form><p>Name</p><input></form></article><section id='comments'><p>Nice, nice, nice, nice, nice, nice, nice.</p></section>",
        f"<!-- <p>hidden</p> --><article title='a > b'><div class=body>{BODY}</div></article><div class='newsletter-box'><p>Subscribe, now, here, please.</p></div>",
        f"<table><tr><td class=nav><a href=1>one</a> <a href=2>two</a></td><td>{BODY}</td></tr></table>",
        f"<article>{BODY}",
    ],
)
def test_layouts(page):
    assert extract(page) == WANT


LINKS = "<ul><li><a href=1>One source</a></li><li><a href=2>Another source</a></li><li><a href=3>A third</a></li></ul>"


@pytest.mark.parametrize("inside", [LINKS, "<div class='social-history'><p>One source</p><p>Another source</p><p>A third</p></div>", "<p id='notice-period'>One source</p><p>Another source</p><p class=related-work>A third</p>"])
def test_article_text_is_kept(inside):
    page = f"<body><nav>{LINKS}</nav><div class='related-posts box2'>{LINKS}</div><article>{BODY}{inside}</article><div id=siteFooter><p>Foot, foot, foot, foot.</p></div></body>"
    assert extract(page) == f"{WANT}\nOne source\nAnother source\nA third"


def test_edges():
    assert extract(None) == extract("") == extract("<script>x") == ""
    assert extract("just text") == "just text"
    assert extract("<p>a<p>b<br>c") == "a\nb c"
    assert extract("<div>" * 30000 + "deep" + "</div>" * 30000) == "deep"
    assert extract("<a \"" * 5000 + "x") is not None
    assert extract("<article><h1>T</h1><p>Auxpa.</p></article>") == "T\nAuxpa."
    long = "word, " * 200000
    assert extract(f"<p>{long}</p>") == long.strip()


def test_template_pages_lose_nothing():
    import html
    import re

    paths = glob.glob("/root/testdata/sf0.01/pages.parquet")
    assert paths
    for path in paths:
        for page in pq.read_table(path)["html"].to_pylist():
            inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
            parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
            assert extract(page) == "\n".join(p for p in parts if p)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "<p>x</p>", 6), (2, None, "<p>x</p>", 6)], "page_id long, url string, html string, text int")
    out = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(df).collect())
    assert out == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract_main_text(df.limit(0)).count() == 0

import html
import re

import pytest

from riskgraph.llm import html_extract as H
from riskgraph.llm import queries

from .helpers import SF, rows


def article_blocks(page):
    """Text of the table's pages, whose article holds one heading and paragraphs."""
    body = page.split("<article>", 1)[1].split("</article>", 1)[0]
    parts = re.split(r"<p>|</p>|</?h1>", body.replace("<b>", ""))
    return [x for p in parts if (x := " ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", p)).split()))]


def test_query_gives_the_articles(spark):
    got = {r["page_id"]: r for r in queries.op10_html_extract(spark, SF).collect()}
    for i, url, page in rows("pages", "page_id, url, html"):
        want = "\n\n".join(article_blocks(page))
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, want, len(want))


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("plain text", "plain text"), ("<p>a", "a"), ("<nav><a href=x>y</a></nav>", ""),
    ('<div id="content"><h2>T</h2><p>One, two.</p><p>Three</p></div><div id="comments"><p>nice, really, cool, yes, yes, yes.</p></div>',
     "T\n\nOne, two.\n\nThree"),
    ("<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>A &amp; b&nbsp;c</p><ul><li>x<li>y</ul>"
     '<aside>side</aside><section class="comments"><p>c</p></section></article></main><div class="cookie-notice">We use</div>',
     "Title\n\nA & b c\n\nx\n\ny"),
    ("<div class='post-content'>Loose text<br>and  more<p>Para, one.</p>tail</div><div class=sidebar><p>x,y,z,w</p></div>",
     "Loose text and more\n\nPara, one.\n\ntail"),
    ('<article><p>Alpha<script>if (a < b) "</p>"</script> beta<div class="ad">AD</div><form><p>send</p></form><p>Gamma</article>',
     "Alpha beta\n\nGamma"),
    ('<div class="site-header"><p>Site, name, here</p></div><div class="post"><div class="post-header"><h1>T</h1></div><p>Body, text.</p></div>'
     '<div class="cookiebar"><p>We, use, cookies</p></div><div id="copyright"><p>c</p></div>', "T\n\nBody, text."),
    ('<article><div class="header"><h1>T</h1></div><p>Body.</p><div class="text-ad">buy</div></article>', "T\n\nBody."),
    ("<body><p>first, with text.</p><p>second.</p><footer>f</footer></body>", "first, with text.\n\nsecond."),
    ("<article><p>cut off in a ta<a hr", "cut off in a ta"), ("<p>x &lt; y &#233; &#x4e2d; &am</p>", "x < y é 中 &am")])
def test_pages(page, text):
    assert H.main_text(page) == text


def test_long_and_awkward_rows(spark):
    long = "<article>" + "<p>word, word</p>" * 40000 + "</article>"
    data = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x</p>", 2), (3, "v", long, 3), (4, "w", "<div>" * 3000 + "deep", 4)]
    out = H.extract(spark.createDataFrame(data, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in out) == [(0, 1), (1, 0), (1, 0), (3, 40000 * 12 - 2), (4, 4)]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG, SHORT, TINY = "<p>" + "one, two, " * 40 + "</p>", "<p>" + "three, four, " * 8 + "</p>", "<p>a card</p>"


@pytest.mark.parametrize("page, kept, left", [
    (f"<main><article>{LONG}</article><article>{SHORT}</article></main>", ["one", "three"], []),
    (f"<main><article>{SHORT}</article><article>{LONG}</article><article>{TINY}</article></main>", ["one", "three"], ["a card"]),
    (f"<main><h1>Title</h1><p>lead</p><article>{LONG}</article><div class=related>{SHORT}</div></main>", ["Title", "lead", "one"], ["three"]),
    (f"<main><h1>Title</h1><section><article><div>{LONG}</div></article><article><div>{SHORT * 3}</div></article></section></main><p>out</p>",
     ["Title", "one", "three"], ["out"]),
    (f"<div><article>{LONG}</article><article>{SHORT}</article></div><div>{TINY}</div>", ["one", "three"], ["a card"])])
def test_siblings_of_the_article(page, kept, left):
    text = H.main_text(page)
    assert all(x in text for x in kept) and not any(x in text for x in left)


PARAS = "".join(f"<p>Paragraph {i} of the story, with some, more, words in it.</p>" for i in range(6))
COMMENT = "<p>nice, really, very, very nice, I think, yes, and, so, on, and, on, well, well, well.</p>"


@pytest.mark.parametrize("page, kept, left", [
    (f'<main><article>{PARAS}</article><article class="comment">{COMMENT}</article></main>', "Paragraph 5", "nice"),
    (f'<main><article><p>Short.</p></article><section id="responses"><article>{COMMENT * 3}</article></section></main>', "Short.", "nice"),
    (f'<main><article><p>Short.</p></article><article class="comment">{COMMENT * 3}</article><article id="reply-2">{COMMENT}</article></main>', "Short.", "nice"),
    (f'<div>{PARAS}</div><article class="comment">{COMMENT}</article>', "Paragraph 5", "nice"),
    (f'<main class="comments-page"><article>{PARAS}</article></main>', "Paragraph 5", "nice"),
    (f'<main><h1>T</h1><article class="notice">{PARAS}</article></main>', "Paragraph 5", "nice"),
    (f'<article class="sponsored">{PARAS}</article>', "Paragraph 5", "nice")])
def test_comments_in_articles(page, kept, left):
    text = H.main_text(page)
    assert kept in text and left not in text


@pytest.mark.parametrize("make", [
    lambda n: "<a " * n + '"', lambda n: "<a<" * n + '"', lambda n: '<a "b" ' * n + "'", lambda n: """<a "b' """ * n + '"',
    lambda n: "<div>" * n + "<p>deep, text</p>", lambda n: "<table>" + "<div>" * n + "</li>" * n + "x", lambda n: "<div>" * n + "</section>" * n,
    lambda n: "<p>" + "<b " * n, lambda n: "<div>" * n + "<li>" * n, lambda n: "<article>" * n + "text, text", lambda n: "<" * n, lambda n: "<div class='" * n])
def test_linear_time(make):
    import time

    def seconds(n):
        page = make(n)
        start = time.process_time()
        H.main_text(page)
        return time.process_time() - start

    seconds(100)
    assert seconds(40000) < 16 * max(seconds(5000), 0.02)  # eight times as long


def test_broken_tags_are_text():
    assert H.main_text('<p>a < b and <i "never closed</p>') == 'a < b and <i "never closed'
    assert H.main_text("""<p title='a>b' class="x<y">text</p>""") == "text"
    assert H.main_text("<p>x<a href='u>v'>link</a>, y</p>") == "xlink, y"

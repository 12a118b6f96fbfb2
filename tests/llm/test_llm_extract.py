import html
import re
import time

import pytest

from helpers import frame
from costmart.llm import extract

CASES = [
    ("", ""), ("plain text only", "plain text only"), ("<p>a<a hre", "a"),
    ("<p>one &amp; two&nbsp;  three\n four</p>", "one & two three four"),
    ("<body><script>var a='<p>x</p>'</script><p>Text.</p><!-- <p>no</p>", "Text."),
    ("<p>kept</p><script>if (a<b) {", "kept"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<article><p>Be.</p><p>The longer paragraph of this article has many words.</p></article>"
     "<p>outside</p>", "Be.\nThe longer paragraph of this article has many words."),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert extract.main_text(page) == text


def test_everything_but_the_article_goes():
    page = """<html><head><title>T</title><body class="home sidebar-left">
    <div id=cookie-notice>We use cookies <button>OK</button></div>
    <header><h1>Site</h1><nav>Menu</nav></header><div class="layout with-sidebar"><main><article>
    <header><h2>Title &amp; more</h2></header><p>First para one two three four five six.</p>
    <ul><li>a<li>b</ul><p>Short.</p><div class="share-bar">Share</div><div class="ad">Buy</div>
    <section id="comments"><p>Nice post, this is a long comment by a reader</p></section></article>
    </main><aside>Side</aside></div><form><label>Mail</label><input></form>
    <style>p{}</style><footer>Foot</footer></body>"""
    assert extract.main_text(page) == \
        "Title & more\nFirst para one two three four five six.\na\nb\nShort."


def test_region_without_article_tag():
    page = """<body><div class=menu><a>x</a><a>y</a></div><div id=content><h1>Head</h1><div>
    <p>Long text of the article, many words in it, more words.</p>
    <p>Second long text of the article with many words in it.</p></div><p>Yes.</p></div>
    <div class="comment-list"><p>Long reader comment, long long long long long.</p></div>"""
    assert extract.main_text(page).split("\n")[0] == "Head"
    assert extract.main_text(page).endswith("Yes.") and "comment" not in extract.main_text(page)


def test_table_of_pages_against_its_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"] or "", re.S)
        want = ""
        if inner:
            lines = re.sub(r"<br>|</?p>|</?h1>", "\n", inner.group(1))
            lines = html.unescape(re.sub(r"<[^>]*>", "", lines)).split("\n")
            want = "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_nulls_clashes_and_empty(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (2, "u", "", None),
            (3, "u", "<p>" + "word " * 50_000, "x"), (3, "u", "<p>" + "word " * 50_000, "x")]
    schema = "page_id long, url string, html string, text string"
    got = extract.extract(frame(spark, rows, schema)).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == \
        [("1", 0), ("2", 0), ("3", 249_999), ("3", 249_999), ("None", 1)]
    assert extract.extract(frame(spark, [], schema)).collect() == []


BODY = [f"Paragraph {i} of the page's own text, with a good many words in it." for i in range(6)]


def test_a_teaser_article_does_not_replace_the_text():
    page = "<body><div id=a>" + "".join(f"<div>{x}</div>" for x in BODY) + \
        "</div><div class=grid><article><a href=x>Other</a> <b>story</b></article></div></body>"
    assert extract.main_text(page).split("\n")[:6] == BODY


def test_sibling_articles_are_joined():
    page = "<body><div class=menu><a>x</a></div><div>" + \
        "".join(f"<article><p>{x}</p><p>Yes.</p></article>" for x in BODY) + "</div></body>"
    assert extract.main_text(page) == "\n".join(f"{x}\nYes." for x in BODY)


def test_the_clustering_decides():
    links = "".join(f"<div><span><a href={i}><i><b>Link {i}</b></i></a></span></div>" for i in range(30))
    page = f"<body><article>{''.join(f'<p>{x}</p>' for x in BODY)}</article><div>{links}</div></body>"
    assert extract.main_text(page) == "\n".join(BODY)
    assert "Link 7" in extract.main_text(page, level=-1e9)


LONG = "word " * 60


@pytest.mark.parametrize("part, kept", [
    ('<pre><span class="comment"># set x</span>\nx = 1</pre>', "# set x x = 1"),
    ('<section class="related-work"><p>Earlier work.</p></section>', "Earlier work."),
    ('<section id="social-history"><p>A history.</p></section>', "A history."),
    ('<p class="alert">Mind the step.</p>', "Mind the step."),
    ("<p>Let <math>x</math> be <label>one</label>.</p>", "Let x be one."),
    ("<p>one<br>two</p>", "one two"),
    ("<header><h2>Part</h2></header>", "Part"),
    ('<div class="comments"><p>First!</p></div>', None),
    ('<div class="social-share">Share this</div>', None),
    ('<ul class="related-posts"><li>More</li></ul>', None),
    ('<p class="advert">Buy this</p>', None), ("<aside>Beside</aside>", None)])
@pytest.mark.parametrize("outer", ["article", 'div id="content"'])
def test_marks_inside_the_article(part, kept, outer):
    html = (f"<body><header>Site</header><nav>Menu</nav><{outer}><p>{LONG}</p>{part}<p>{LONG}</p>"
            f"</{outer.split()[0]}><footer>Foot</footer></body>")
    lines = extract.main_text(html).split("\n")
    assert lines[0] == lines[-1] == LONG.strip()
    assert lines[1:-1] == ([kept] if kept else [])


def test_header_of_a_named_container():
    html = (f'<body><header>Site</header><div id="content"><header><h1>Title</h1></header>'
            f"<p>{LONG}</p></div><footer>Foot</footer></body>")
    assert extract.main_text(html) == "Title\n" + LONG.strip()


@pytest.mark.parametrize("open_tags", ["<div>" * 100_000, "<div><p>" * 50_000, "<b>" * 100_000,
                                       "<ul><li>" * 50_000, "<article>" * 100_000])
def test_deep_nesting_takes_linear_time(open_tags):
    start = time.process_time()
    assert extract.main_text(open_tags + LONG) == LONG.strip()
    assert time.process_time() - start < 20

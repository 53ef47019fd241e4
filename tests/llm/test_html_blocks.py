"""HTML extraction: block rules, references, white space, and pages of known content."""

import html
import re
import time

from tests.llm.helpers import SF, rows_of
from tillroll.llm import html_blocks as H

LONG = "The river and the old walls of the town are what they have been for all of us, and it is there that we were to go. " * 3
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>'


def test_boilerplate_goes():
    page = (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{NAV}"
            f"<div class='ad'>{LONG}</div><aside>{LONG}</aside><div id=\"cookie-banner\">{LONG}</div><form>{LONG}</form>"
            f"<div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><section class='comments'><p>{LONG}</p></section>"
            f"<footer>&copy; x {LONG}</footer><!-- {LONG} -->")
    want = H._SPACE.sub(" ", LONG).strip()
    assert H.main_text(page) == f"{want}\nShort one.\n{want}"


def test_references_and_space():
    assert H.main_text("<article><p>a &amp;&amp; b&nbsp;c\n\t d &lt;i&gt; &#233; <b>x</b>y</p></article>") == "a && b c d <i> é xy"
    assert H.main_text("<main>one<br>two<p>three</main>") == "one\ntwo\nthree"
    assert H.main_text("<article>a < b and 1<2 &unknown; <i>c</article>") == "a < b and 1<2 &unknown; c"


def test_second_pass():
    good, bad = f"<p>{LONG}</p>", f"<p><a href='x'>{LONG}</a></p>"
    verdicts = lambda page: H.second_pass(b := H.blocks(page), [H.first_pass(x) for x in b])      # noqa: E731
    assert verdicts(good + "<p>short</p>" + good) == [True, True, True]
    assert verdicts(bad + "<p>short</p>" + bad) == [False, False, False]
    assert verdicts(bad + "<p>short</p>" + good) == [False, False, True]
    assert verdicts(bad + "<h2>Head</h2>" + good) == [False, True, True]
    assert verdicts(f"{NAV}<article><p>Be.</p></article><footer>end</footer>")[2:3] == [True]


def test_broken_pages():
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<nav>x</nav>") == ""
    assert H.main_text("<script>if (a<b) x('<p>')") == "" and H.main_text("<!-- never closed <p>x</p>") == ""
    assert H.main_text("</div></p><article><p>kept") == "kept"
    assert len(H.main_text("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 5 - 1


def test_pages(spark):
    """The test pages hold one article; everything in it and nothing else is the main text."""
    for r in H.op6_html_blocks(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:h1|p|br)>", body)]
        assert r.text == "\n".join(t for t in want if t) and r.n_chars == len(r.text)


def test_frames(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "<article>hi</article>", "old"), (2, "<article>hi</article>", "old")],
                                  "page_id long, html string, text string")
    got = H.extract_main_text(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "", 0), (2, "hi", 2), (2, "hi", 2)]
    assert H.extract_main_text(pages.limit(0)).count() == 0 and rows_of(pages, "page_id")


def test_names_of_the_whole_page_mark_nothing():
    want = H._SPACE.sub(" ", LONG).strip()
    for page in (f"<body class='page has-sidebar'><p>{LONG}</p>", f"<body class='sidebar'><p>{LONG}</p>",
                 f"<article class='post comments-open'><p>{LONG}</p></article>", f"<main id=menu><p>{LONG}</p></main>",
                 f"<div id='page-header-content'><p>{LONG}</p></div>"):
        assert H.main_text(page) == want, page
    assert H.main_text(f"<div class='box sidebar'><p>{LONG}</p></div>") == ""


def test_head_without_end():
    want = H._SPACE.sub(" ", LONG).strip()
    head = "<html><head><meta charset=utf-8><title>T</title><script>x('<p>no</p>')</script>"
    assert H.main_text(f"{head}<body><p>{LONG}</p>") == want
    assert H.main_text(f"{head}<p>{LONG}</p>") == want
    assert H.main_text(f"{head}</head><body><p>{LONG}</p>") == want


def test_other_languages():
    text = ("Rzeka i stare mury miasta widziały już wiele pokoleń kupców, którzy każdej wiosny przywozili tutaj sól, sukno oraz "
            "bursztyn znad morza. Dzisiaj nad brzegiem stoją nowe domy, lecz dawny rynek nadal żyje własnym rytmem targów.")
    footer = "<footer>x</footer>"
    assert H.main_text(f"<body>{NAV}<div><p>{text}</p><p>{text}</p></div>{footer}") == f"{text}\n{text}"
    keywords = "cheap shoes online buy shoes discount sale " * 6                       # still bad on a page of known language
    assert keywords[:20] not in H.main_text(f"<p>{LONG * 2}</p><p>{keywords}</p>")


def test_names_by_their_head():
    want = H._SPACE.sub(" ", LONG).strip()
    junk = ("site-header main-nav comment-list comments-area reader-comments cookie-consent ad-slot ad-container sidebar-left "
            "newsletter-signup commentList ad_unit_3 related-articles share-buttons global-footer comments-2").split()
    for name in junk:
        block = f"<div class='x {name}'><p>{LONG}</p></div>"
        assert H.main_text(f"<p>{LONG}</p>{block}<p>{LONG}</p>") == f"{want}\n{want}", name
        assert H.main_text(f"<article><p>{LONG}</p>{block}</article>") == want, name
    for name in "has-sidebar comments-open page-header-content entry-header post-footer no-ads with-comments is-menu nav-open adventure".split():
        assert H.main_text(f"<div class='{name}'><p>{LONG}</p></div>") == want, name


def test_quotes_inside_unquoted_values():
    assert H.main_text("<article><p title=it's>one</p><p title='a>b' data-x=\"c>d\">two</p><p a=\"b>three</p></article>") == "one\ntwo\nthree"
    assert H.main_text("<article><p it's>one</p><p x = 'y>z'>two</p></article>") == "one\ntwo"


def test_paragraphs_of_an_article_may_be_links():
    page = f"<body>{NAV}<article><h1><a href='x'>Title</a></h1><p><a href='x'>{LONG}</a></p><p>{LONG}</p></article></body>"
    want = H._SPACE.sub(" ", LONG).strip()
    assert H.main_text(page) == f"Title\n{want}\n{want}"
    assert H.main_text(f"<p><a href='x'>{LONG}</a></p>") == ""


def test_pages_without_an_article():
    want = H._SPACE.sub(" ", LONG).strip()
    page = (f"<html><body><div class='site-header'>Name of the site</div>{NAV}<div id='content'><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
            f"<div class='comment-list'><p>{LONG}</p></div><div class='site-footer'>{LONG}</div></body></html>")
    assert H.main_text(page) == f"Title\n{want}\nShort.\n{want}"


def test_a_megabyte_of_unclosed_tags():
    for unit in ("a <b ", "<div class='x ", "<b =\"", "<!", "<!--", "<", "</", "<b =' >\"", "&amp", "<p ="):
        for tail in ("", ">", "=\" > \""):
            began = time.process_time()
            H.main_text(unit * (1_000_000 // len(unit)) + tail)
            assert time.process_time() - began < 10, (unit, tail)
    assert H.main_text("<article>a <b c") == "a <b c" and H.main_text("<article>x </ y") == "x </ y"

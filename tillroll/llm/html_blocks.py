"""Main text of HTML pages by two-pass block rules.

The page is cut into text blocks at block-level tags.  Pass 1 labels each block by link
density, length and stop-word density: good, bad, or undecided (``near good`` for medium
and ``short`` for short ones); blocks inside menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like are bad.  Pass 2 gives undecided blocks the label
of their nearest decided neighbours: good if the neighbours on both sides are good, bad
if both are bad; between a good and a bad one a near-good block is good and a short block
good only inside the page's article.  A heading is good if the next decided block is.

Names (class, id, role) of menus and the like count by their head: ``reader-comments``,
``comment-list`` and ``ad-slot`` are, ``has-sidebar``, ``comments-open``, ``entry-header``
and ``page-header-content`` are not.

Blocks of <article> or <main> are decided among themselves: markup says they are content,
so neighbours outside do not count for them, long blocks there need no stop words, and
paragraphs of an article may be links from end to end.  Nor do long blocks anywhere on a page whose language the stop words do not fit.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by one \\n.

Edge cases: null and empty pages, and pages without good blocks, give an empty text;
unclosed elements, comments and scripts are closed by the end of the page, and a tag that
never ends is text with all that follows it (so a scan is linear); repeated rows get equal results; an empty table gives an empty result; an input column
named like an output column is replaced; pages are read whole.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.arrowtools import append_columns, longs

MAX_LINK_DENSITY = 0.2
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW = 0.30
STOP_HIGH = 0.32

# Tags and names.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas title select option textarea button".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
PROSE = HEADINGS | frozenset("p blockquote pre figcaption dd td br".split())
WHOLE = frozenset("html body main article".split())         # their names tell of the page, not of what they hold
IN_HEAD = frozenset("base link meta head html".split())     # besides SKIPPED; any other tag ends an open head
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header "
    "menu modal nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split())
# Parts of names.  A boilerplate name is the last part (``site-header``), or the first
# with a part of its layout as the last (``comment-list``).
LAYOUT = frozenset(
    "area articles bar block body bottom box buttons cards col column consent container content-box feed form group holder icons inner "
    "item items label left links list modal note outer overlay panel placeholder popup posts reply right row section signup slot slots "
    "stories strip text thread title top unit units widget wrap wrapper zone".split())
STATES = frozenset("has is no not with without hide show js".split())
OWN_HEADERS = frozenset("article content entry post story".split())     # an article's own header and footer

STOP_WORDS = frozenset((
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its "
    "me more my no not of on one or our out over she so some than that the their them then there these they this to up was "
    "we were what when where which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas "
    "plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist "
    "mit nach nicht noch nur oder sich sie sind so und uns von vor war wie wir wird zu zum zur "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no "
    "nos o para pero por que se ser si sin sobre son su sus también un una y ya").split())

# Quotes count only behind "=".  No part gives back what it took, so every tag is tried once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
                    r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|([^<]++|<)", re.DOTALL)
_TAG_BEGINS = re.compile("</?[A-Za-z]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "links", "tag", "bad", "article", "prose")

    def __init__(self, text: str, links: int, tag: str, bad: bool, article: bool, prose: bool = False):
        self.text, self.links, self.tag, self.bad, self.article = text, links, tag, bad, article
        self.prose = prose                                  # an article's paragraph or heading, whatever it links to


def _names_boilerplate(name: str) -> bool:
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if p]
    if not parts or parts[0] in STATES:
        return False
    if BOILERPLATE_NAMES.issuperset(parts):
        return True
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if parts[-1] in BOILERPLATE_NAMES:
        return not (parts[-1] in ("header", "footer") and parts[0] in OWN_HEADERS)
    return parts[0] in BOILERPLATE_NAMES and parts[-1] in LAYOUT


def _is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if "=" not in attributes:
        return False
    if re.search(r"\bhidden\b", _NAMES.sub("", attributes)) or "display:none" in attributes.replace(" ", ""):
        return True
    if tag in WHOLE:
        return False
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).split()
    return any(map(_names_boilerplate, names))


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with their link characters and surroundings."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, bool, bool]] = []            # (tag, boilerplate, article) of open elements
    skip = ""                                               # the skipped element that is open
    in_head = False
    tag_of_block = "body"
    in_link = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                links = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip())
                in_article = any(t[0] == "article" for t in open_tags)
                out.append(Block(text, links, tag_of_block, any(t[1] for t in open_tags), any(t[2] for t in open_tags),
                                 in_article and tag_of_block in PROSE))
        parts, linked = [], []

    for m in _TOKEN.finditer(page):
        text = m.group(4)
        if text is not None:
            if text == "<" and _TAG_BEGINS.match(page, m.start()):
                text = page[m.start():]                     # no tag ends any more
            if in_head and not skip and text.strip():
                in_head = False                             # as in browsers, text begins the body
            if not skip and not in_head:
                parts.append(text)
                if in_link:
                    linked.append(text)
            if len(text) > m.end() - m.start():
                break
            continue
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if skip:
            if m.group(1) and tag == skip:
                skip = ""
            continue
        if tag in SKIPPED:
            if not m.group(1) and not m.group(3).endswith("/"):
                if tag in BLOCKS:
                    flush()
                skip = tag
            continue
        if tag == "head":
            flush()
            in_head = not m.group(1) and not m.group(3).endswith("/")
            continue
        if in_head and not m.group(1) and tag not in IN_HEAD:
            in_head = False                                 # </head> may be left out
        if tag == "a":
            in_link = 0 if m.group(1) else 1
            continue
        block = tag in BLOCKS
        if block:
            flush()
            in_link = 0
        if m.group(1):
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    break
        elif tag not in VOID and not m.group(3).endswith("/"):
            bad = _is_boilerplate(tag, m.group(3))
            if tag in ("header",) and any(t[2] for t in open_tags):
                bad = False                                 # an article's own header holds its title
            if block and tag in ("p", "li") and open_tags and open_tags[-1][0] == tag:
                open_tags.pop()                             # closed by the next one
            open_tags.append((tag, bad, tag in ARTICLE))
        if block and not m.group(1):
            tag_of_block = tag
    flush()
    return out


def _stop_words(block: Block) -> tuple[int, int]:
    words = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def knows_language(items: list[Block]) -> bool:
    """Whether the stop words fit the page: they do if its link-poor text, as a whole, has enough of them."""
    counts = [_stop_words(b) for b in items
              if not b.bad and len(b.text) >= SHORT_CHARS and b.links <= MAX_LINK_DENSITY * len(b.text)]
    stops, words = sum(s for s, _ in counts), sum(w for _, w in counts)
    return not words or stops >= STOP_LOW * words


def first_pass(block: Block, known: bool = True) -> str:
    """good, bad, near (undecided, medium) or short (undecided, short); ``known``: the stop words fit the page."""
    n = len(block.text)
    if block.bad or block.links > MAX_LINK_DENSITY * n and not block.prose:
        return "bad"
    if n < SHORT_CHARS:
        return "short"
    stops, words = _stop_words(block)
    density = stops / words if words else 0.0
    if density >= STOP_HIGH:
        return "good" if n > LONG_CHARS else "near"
    if density >= STOP_LOW:
        return "near"
    if block.article or not known and words:
        return "good" if n > LONG_CHARS else "near"
    return "bad"


def second_pass(items: list[Block], labels: list[str]) -> list[bool]:
    """Final verdicts: undecided blocks inherit from their nearest decided neighbours."""
    n = len(items)
    out = [label == "good" for label in labels]
    before: list[str | None] = [None] * n
    after: list[str | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        seen: dict[bool, str] = {}                          # nearest decided label, by article or not
        for i in order:
            near[i] = seen.get(items[i].article)
            if labels[i] in ("good", "bad"):
                seen[items[i].article] = labels[i]
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            continue
        around = [x for x in (before[i], after[i]) if x is not None]
        if not around:
            out[i] = items[i].article or label == "near"
        elif items[i].tag in HEADINGS and after[i] == "good":
            out[i] = True
        elif len(set(around)) == 1:
            out[i] = around[0] == "good"
        else:
            out[i] = label == "near" or items[i].article
    return out


def main_text(page: str | None) -> str:
    """Good blocks of a page, joined by line breaks."""
    if not page:
        return ""
    items = blocks(page)
    known = knows_language(items)
    good = second_pass(items, [first_pass(b, known) for b in items])
    return "\n".join(b.text for b, keep in zip(items, good) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` plus the main text of every page."""
    return append_columns(pages, html_col, f"`{out_col}` string, n_chars long", lambda column: _extract(column, out_col))


def _extract(column: pa.Array, out_col: str) -> dict[str, pa.Array]:
    texts = [main_text(p) for p in column.to_pylist()]
    return {out_col: pa.array(texts, pa.string()), "n_chars": longs([len(t) for t in texts])}


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

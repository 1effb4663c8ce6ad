"""HTML extraction by two-pass block rules.

A page is cut into blocks at block tags.  Pass 1 decides blocks by where they stand (navigation, forms, comments, adverts),
and by length, link density and density of stop words: on a page without an article all blocks, on one with an article
those whose names speak against them and its lists.  A container's name is evidence only: an article below it, the
densities of its text, or a page on which nothing else is text overrule it.  Short blocks that those rules leave open
inherit, in pass 2, the label of the nearest decided neighbour; of two as near, the one in the same container.  In a
language whose stop words aren't known, length and links decide.  Spark deals the pages; a page is parsed by a small
scanner, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag names of HTML, tokens of class, id and role that mark what isn't article text, common words.
RAW = {"script", "style", "noscript", "template", "textarea", "select", "option", "button", "svg", "iframe", "object", "title", "head"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "fieldset", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "hr", "body", "html", "center", "dialog", "menu"}
CONTAINERS = BLOCKS - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
AWAY = {"nav", "aside", "footer", "form", "menu", "dialog"}
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "menu", "nav", "navbar", "navigation", "navigationbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchform", "form", "widget", "contentinfo", "complementary", "dialog", "reviews",
}
# Tags whose text goes to the end of the page where they aren't closed.
SWALLOW = {"script", "style", "textarea", "iframe", "noscript", "template"}
# Parts of a name that say that it is about the page's layout: at its begin; at its end, outside an article.
WITH, LAYOUT = {"has", "no", "with", "without"}, {"wrap", "wrapper", "container", "layout", "page", "content", "results", "inner"}
# What comes last in names of parts that aren't text, after what they are for.
PARTS = {"list", "links", "link", "buttons", "button", "bar", "box", "area", "items", "item", "icons", "posts", "articles", "stories", "widget", "block", "panel", "wrap", "wrapper", "container"}
# What stands above a block: nothing, a name of the layout with a mark, a mark, what takes it away for good.
FREE, WEAK, MARKED, GONE = range(4)
COMMENT_MARKS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "ad", "ads", "advert", "promo", "sponsored", "related", "teaser"}
STOP_WORDS = set(
    "the of and to in a is that it for was on are with as at be this by have from or had but not what all were when we there can an your which their said if do will each about"
    " le la les de des du et un une en est que qui dans pour pas sur au avec par plus ce il elle ne se sont"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " el los las y una por con para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of pass 1: a block of ``long`` characters and ``stop`` is text; ``menu`` items that are links are a menu."""

    long: int = 80
    short_stop: float = 0.3
    stop: float = 0.15
    links: float = 0.4
    menu: int = 3


@dataclass
class Block:
    text: str
    link_chars: int
    away: bool
    article: bool
    heading: bool
    container: int
    item: bool = False
    doubt: int = FREE
    label: bool | None = None


def marks_of(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    return {x.lower() for m in ATTRIBUTES.finditer(attributes) for x in re.split(r"[^A-Za-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "")) if x}


def doubt_of(attributes: str, article: bool) -> int:
    """FREE, WEAK, MARKED or GONE by the names of a container."""
    most = FREE
    for m in ATTRIBUTES.finditer(attributes) if "=" in attributes else ():
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [x.lower() for x in re.split(r"[^A-Za-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name)) if x]
            if MARKS.intersection(parts) or COMMENT_MARKS.intersection(parts):
                # what a name is comes last, what it is for before: "site-footer" is a footer, "share-text" is text
                head = next((x for x in reversed(parts) if x not in LAYOUT), parts[-1])
                known = MARKS | COMMENT_MARKS
                if parts[0] in WITH or (parts[-1] in LAYOUT and not article and not COMMENT_MARKS.intersection(parts)):
                    most = max(most, WEAK)
                elif COMMENT_MARKS.intersection((parts[0], head)):
                    most = GONE
                else:
                    most = max(most, MARKED if head in known or len(parts) == 2 and parts[0] in known and parts[1] in PARTS else WEAK)
    return most


def wrapping_forms(lower: str) -> set[int]:
    """Ends of the start tags of forms that are the page's frame: they hold an article, or most of its paragraphs where there is none."""
    forms = [m.end() for m in re.finditer(r"<form\b[^>]*>", lower)]
    if not forms:
        return set()
    closes, paragraphs = ([m.start() for m in re.finditer(x, lower)] for x in (r"</form\b", r"<p[\s>]"))
    articles = [m.start() for m in re.finditer(r"<(?:article|main)\b", lower)]
    out = set()
    for at in forms:
        close = bisect_left(closes, at)
        end = closes[close] if close < len(closes) else len(lower)
        inside = lambda places: bisect_left(places, end) - bisect_left(places, at)  # noqa: B023, E731
        if inside(articles) or not articles and inside(paragraphs) >= 3 and 2 * inside(paragraphs) > len(paragraphs):
            out.add(at)
    return out


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    lower = page.lower()
    frames = wrapping_forms(lower) if len(lower) == len(page) else set()
    closing = {t: lower.rfind(f"</{t}") for t in AWAY | RAW | {"header"}}
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", FREE, False, 0)]  # tag, doubt, in an article, number
    parts: list[str] = []
    links, in_link, heading, number, at, leaf, item = 0, False, False, 0, 0, FREE, False

    def flush() -> None:
        nonlocal links, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, doubt, article, own = stack[-1]
            doubt = max(doubt, leaf)
            out.append(Block(text, links, doubt == GONE, article, heading, own, item, doubt))
        parts.clear()
        links, heading = 0, False

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        piece = page[at : m.start()]
        if piece:
            parts.append(piece)
            links += len(piece.strip()) if in_link else 0
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not end and not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at) if closing[tag] >= at else None
                if close:
                    at = close.end()
                elif tag in SWALLOW:
                    at = len(page)
            continue
        if tag == "a":
            in_link = not end
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            heading = tag[0] == "h" and tag[1:].isdigit() and not end
            leaf = doubt_of(m[3], stack[-1][2]) if tag not in CONTAINERS and not end else FREE
            item = tag == "li" and not end or item and tag not in CONTAINERS
            if tag in CONTAINERS and not end:
                number += 1
                _, doubt, article, _ = stack[-1]
                if tag in ("article", "main"):  # resets what generic wrappers are named
                    doubt, article = GONE if doubt == GONE or marks_of(m[3]) & COMMENT_MARKS else FREE, True
                elif tag not in ("html", "body"):
                    gone = (tag in AWAY and closing[tag] > at and at not in frames) or (tag == "header" and not article and closing[tag] > at)
                    doubt = GONE if gone else doubt if at in frames else max(doubt, doubt_of(m[3], article))
                stack.append((tag, doubt, article, number))
            elif tag in CONTAINERS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def label(blocks: list[Block], rules: Rules) -> None:
    """Decide every block: pass 1 by rules, pass 2 by the nearest decided neighbour."""
    named = any(b.article and b.doubt < MARKED for b in blocks)
    density = [stop_density(b.text) for b in blocks]
    spoken = any(d >= rules.stop and len(b.text) >= rules.long and not b.away for b, d in zip(blocks, density))

    def by_density(b: Block, stop: float, links: float) -> bool | None:
        if b.link_chars > links * len(b.text):
            return False
        if len(b.text) >= rules.long:
            return True if stop >= rules.stop or not spoken else None
        if not WORDS.search(b.text):
            return False
        return True if stop >= rules.short_stop and len(b.text) >= rules.long // 2 and not b.heading else None

    listed = menus(blocks, rules)
    for i, (b, stop) in enumerate(zip(blocks, density)):
        if b.away:
            b.label = False
        elif named:  # an article is text, but for lists of links and parts whose name and densities both speak against them
            b.label = b.article and b.doubt < MARKED and not listed[i]
            if b.label and b.doubt == WEAK:
                b.label = bool(by_density(b, stop, rules.links / 2))
        elif b.doubt == MARKED:
            b.label = False
        else:
            b.label = by_density(b, stop, rules.links / (2 if b.doubt == WEAK else 1))
    if not any(b.label for b in blocks):  # then the text may stand in a wrapper with a misleading name
        for b, stop in zip(blocks, density):
            if b.doubt == MARKED and not named:
                b.label = by_density(b, stop, rules.links / 2)
    labels = [b.label for b in blocks]
    before, last = [], None
    for i, x in enumerate(labels):
        before.append(last)
        last = i if x is not None else last
    after: int | None = None
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if labels[i] is not None:
            after = i
        elif b.heading and after is not None and after - i <= 2:
            b.label = labels[after]
        else:
            near = sorted((abs(i - j), blocks[j].container != b.container, j < i, j) for j in (before[i], after) if j is not None)
            b.label = labels[near[0][3]] if near else True


def stop_density(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def menus(blocks: list[Block], rules: Rules) -> list[bool]:
    """Which blocks are items of lists, of ``rules.menu`` in a row or more, that are links and nothing else."""
    out = [b.item and b.link_chars >= 0.9 * len(b.text) for b in blocks]
    start = 0
    for i in range(len(out) + 1):
        if i == len(out) or not out[i]:
            if i - start < rules.menu:
                out[start:i] = [False] * (i - start)
            start = i + 1
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    blocks = blocks_of(page or "")
    label(blocks, rules)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``pages`` with text and n_chars (code points) instead of html.

    White space inside a block is one space, blocks are joined by two line feeds, character references are decoded.  Null,
    empty and unparsable html give ''.  Tags left open end with the page, so cut pages keep what they have.  A page of any
    length is read whole.  Columns named text or n_chars are replaced; others pass through, repeated rows too.
    """
    mine = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("html")
            texts = [main_text(x, rules) for x in batch.column(i).to_pylist()]
            rest = [j for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(batch.schema.names[j] for j in rest), "text", "n_chars"])

    schema = T.StructType([*(f for f in mine.schema if f.name != "html"), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return mine.mapInArrow(run, schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html"))
    return extract(pages)

"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Each block has its text, its share of link characters, its share of stop
words (words are stripped of digits and symbols first, so that noise does not hide them), and the containers that it
lies in.

Pass 1 decides each block alone. *Bad*: it lies in a boilerplate container (nav, footer, aside, form, ..., or an element
whose class, id or role names one: a container by any part of a name, a paragraph, heading, list item or cell by a whole
name alone, so that ``share-price`` is text), or most of its characters are links. *Good*: long enough and dense enough in stop
words. *Near*: long with some stop words, or any long block inside the page's article container. *Short*: all else.
If the page has an article container, blocks outside it are bad.

Pass 2 walks over the ambiguous blocks: a near or short block takes the label of its nearest decided neighbours
within the same container, of both sides if they agree, else the good one if the block is near or adjoins it more closely;
a heading looks forward only. Where no block is decided, blocks of an article
container, near blocks and blocks without links are good.

Both passes are linear in the page: open elements are counted, not walked over, and decided neighbours are carried along.

White space inside a block becomes one space, blocks are joined by a newline in page order, character references are
decoded; nothing is cut off or capped.

Edge cases: null or empty html gives the empty text; truncated pages close all open elements at their end; unclosed and
stray end tags are tolerated; rows repeat as given; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements and words, in plain lists.
DROPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "select", "textarea", "canvas", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text rather than other blocks.
TEXT = {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "caption", "figcaption", "summary", "legend", "address", *HEADINGS}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
BOILERPLATE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "sidebar", "widget",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "trending", "pagination", "pager",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "copyright", "legal", "disclaimer", "alert", "toolbar",
    "contentinfo", "complementary",
}
STOP_WORDS = set(
    """
    a an and are as at be been but by can for from had has have he her his i if in is it its my no not of on or our she so
    than that the their them there they this to up was we were what when which who will with you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im
    in ist ja kann man mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn wie wir zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour
    qu que qui sa se ses son sont sur un une vous
    al como con de del el ella en era es esta este fue ha hay la las lo los más me mi muy ni no nos o para pero por que se si
    sin sobre son su sus también te un una y ya
    """.split()  # noqa: SIM905
)
LINK_SHARE = 0.5
SHORT_CHARS = 60
GOOD_STOPS = 0.25
NEAR_STOPS = 0.10
#: Code points that make a text long in a script without spaces; code points and spaces of a long sentence without stop words.
SPACELESS_CHARS, FOREIGN_CHARS, FOREIGN_WORDS = 25, 200, 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?P<close>>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDED_BY_P, _ENDED_BY_LI = {"p"} | HEADINGS, {"p", "li"} | HEADINGS
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Dropped elements whose content is text up to their first end tag; the others may hold their like, and end with their own.
_RAW = {"script", "style", "textarea", "iframe", "noscript"}
_ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+(?:>|$)", re.I) for t in DROPPED - {"head"}}
#: Scripts that are written without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Chinese characters).
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_PUNCTUATED = re.compile("[\u3001\u3002\uff01\uff0c\uff0e\uff1f\u2026\u104a\u104b\u17d4]")
_SENTENCE_END = re.compile(r"[.!?\u061f\u06d4\u0964][\"'\u00bb\u201d)]*$")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    heading: bool
    container: int
    article: bool
    boilerplate: bool


def _is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "article", "main") or not attrs:
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower()
        if BOILERPLATE_WORDS.intersection(value.split() if tag in TEXT else re.split(r"[^a-z]+", value)):
            return True
    return False


class _Open:
    """The open block elements, with counts of those of each tag and of each property."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, boilerplate, article, container
        self.tags: dict[str, int] = {}
        self.boilerplate = self.articles = self.headings = 0

    def push(self, tag: str, boilerplate: bool, article: bool, container: int) -> None:
        self.stack.append((tag, boilerplate, article, container))
        self._count(tag, boilerplate, article, 1)

    def pop(self) -> str:
        tag, boilerplate, article, _ = self.stack.pop()
        self._count(tag, boilerplate, article, -1)
        return tag

    def _count(self, tag: str, boilerplate: bool, article: bool, by: int) -> None:
        self.tags[tag] = self.tags.get(tag, 0) + by
        self.boilerplate += by * boilerplate
        self.articles += by * article
        self.headings += by * (tag in HEADINGS)

    @property
    def container(self) -> int:
        return self.stack[-1][3] if self.stack else 0


def _behind(page: str, at: int, tag: str) -> int:
    """Where a dropped element that opened before ``at`` ends. One that never ends takes the rest of the page if its content
    is raw text; of others only the tag itself is dropped."""
    depth = 1
    for m in _ENDS[tag].finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag not in _RAW and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page) if tag in _RAW or tag in ("svg", "template") else at


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, empty ones left out."""
    out: list[Block] = []
    parts: list[str] = []
    state = {"links": 0}
    opened = _Open()
    anchors = serial = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, state["links"], opened.headings > 0, opened.container, opened.articles > 0, opened.boilerplate > 0))
        parts.clear()
        state["links"] = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else n]
        if chunk:
            parts.append(chunk)
            if anchors:
                state["links"] += len(chunk.strip())
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCK or tag in BOILERPLATE_TAGS:
                flush()
                anchors = 0
                while opened.tags.get(tag) and opened.pop() != tag:
                    pass
            continue
        if tag in _ENDS and not m["attrs"].rstrip().endswith("/"):
            if tag not in ("svg", "canvas"):
                parts.append(" ")
            at = _behind(page, at, tag)
            continue
        if tag == "head":
            e = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
            at = n if e is None else e.start() if e[0].lower() == "<body" else e.end()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            anchors += 1
        elif tag in BLOCK or tag in BOILERPLATE_TAGS:
            flush()
            anchors = 0
            if tag == "p" or tag in HEADINGS or tag == "li":  # an open one of the same kind ends here
                while opened.stack and opened.stack[-1][0] in (_ENDED_BY_P if tag != "li" else _ENDED_BY_LI):
                    opened.pop()
            if tag not in VOID:
                own = opened.container
                if tag not in ("p", "li", *HEADINGS):
                    serial += 1
                    own = serial
                opened.push(tag, _is_boilerplate(tag, m["attrs"], opened.articles > 0), tag in ("article", "main"), own)
    flush()
    return out


def _stop_share(text: str) -> float:
    words = [w for w in (_NOT_LETTERS.sub("", x) for x in text.lower().split()) if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _prose(text: str, stops: float) -> str | None:
    """What length and punctuation say where stop words cannot: good or near for long text in a script without spaces, good
    for a long sentence of a language of which no stop word is known."""
    letters = len(_SPACELESS.findall(text))
    if 2 * letters > len(text.replace(" ", "")):
        if letters < SPACELESS_CHARS:
            return None
        return "good" if letters >= 3 * SPACELESS_CHARS or _PUNCTUATED.search(text) else "near"
    if not stops and len(text) >= FOREIGN_CHARS and text.count(" ") >= FOREIGN_WORDS and _SENTENCE_END.search(text):
        return "good"
    return None


def first_labels(blocks: list[Block]) -> list[str]:
    """Pass 1: good, bad, near or short for each block."""
    has_article = any(b.article and not b.boilerplate for b in blocks)
    labels: list[str] = []
    for b in blocks:
        if b.boilerplate or (has_article and not b.article) or b.link_chars > LINK_SHARE * len(b.text):
            labels.append("bad")
            continue
        stops, long = _stop_share(b.text), len(b.text) >= SHORT_CHARS
        if stops < NEAR_STOPS and not b.heading and (label := _prose(b.text, stops)):
            labels.append(label)
            continue
        if long and stops >= GOOD_STOPS and not b.heading:
            labels.append("good")
        elif long and (stops >= NEAR_STOPS or b.article):
            labels.append("near")
        else:
            labels.append("short")
    return labels


def _decided_before(blocks: list[Block], labels: list[str], order) -> list[int | None]:
    """For each block the last decided block met in ``order`` before it: for one of an article, the last of an article."""
    found: list[int | None] = [None] * len(blocks)
    nearest = of_article = None
    for i in order:
        found[i] = of_article if blocks[i].article else nearest
        if labels[i] in ("good", "bad"):
            nearest = i
            if blocks[i].article and not blocks[i].boilerplate:
                of_article = i
    return found


def final_labels(blocks: list[Block], labels: list[str]) -> list[str]:
    """Pass 2: ambiguous blocks take the labels of their nearest decided neighbours."""
    final = list(labels)
    befores = _decided_before(blocks, labels, range(len(blocks)))
    afters = _decided_before(blocks, labels, range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            continue
        before, after = befores[i], afters[i]
        if b.heading and after is not None:
            before = None
        sides = {labels[j] for j in (before, after) if j is not None}
        if not sides:
            final[i] = "good" if b.article or labels[i] == "near" or not b.link_chars else "bad"
        elif len(sides) == 1:
            final[i] = sides.pop()
        elif labels[i] == "near" or b.article:
            final[i] = "good"
        else:
            final[i] = labels[before] if i - before <= after - i else labels[after]
    return final


def extract(page: str | None) -> str:
    """The main text of one page; see the module's text."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, label in zip(blocks, final_labels(blocks, first_labels(blocks)), strict=True) if label == "good")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""

    def run(frames):
        for pdf in frames:
            text = [extract(x if isinstance(x, str) else None) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

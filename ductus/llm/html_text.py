"""Main text of web pages by two-pass block rules.

A page becomes blocks (text between block-level tags). Pass one decides a block by its container, link
density, length and stop-word density: kept, dropped or ambiguous. Pass two gives an ambiguous block (a
heading, a short, linked or stop-word-poor one) the label of its nearest decided neighbours.

A container is judged by each of its class names and ids: one that has a boilerplate word as a part (main-nav,
post-sidebar) drops it, unless the name only says that the page has such a part (has-sidebar). A page of which
hardly any word is a stop word is in another language: there sentence punctuation stands for stop words, and
wide characters, of which a word has few, count as WIDE letters each.

Defined cases: null or empty html gives an empty text; a tag or comment that never closes ends with the page,
any other `<` is text; repeated rows give repeated rows; null ids and urls pass through; an empty table gives
an empty table; other columns of the input are not looked at. Pages of any length are read whole; a task holds
SLICE_BYTES of them, or one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import by_bytes, text_or_empty

SLICE_BYTES = 8_000_000
#: Letters of a word that a character of a script without spaces stands for.
WIDE = 2.5

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NOT_LETTER = re.compile(r"[\W\d_]+")
WIDE_CHARACTER = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964\u0f0d](?:\\s|$|(?<=[\u3002\uff01\uff1f]))")
#: A tag that the page's end cuts off: a name alone or with an attribute, or a declaration.
CUT_OFF = re.compile(r"</?[a-zA-Z][^\s<>/=]*\s*/?$|<[a-zA-Z][^\s<>/=]*\s+[^\s<>=]+\s*=|<[!?]")
#: Outside an article; only what claims the rights, not a text about them.
RIGHTS = re.compile(r"\s*(?:©|copyright\s*(?:©|\(c\)|\d{4}|by\b)|\(c\)\s*\d{4}|all rights reserved)", re.I)

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video title textarea select datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start of one of these ends an open paragraph.
BOILERPLATE_TAGS = frozenset("nav header footer aside form button dialog menu fieldset label".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
BOILERPLATE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations teaser teasers footer header masthead toolbar skip search copyright disclaimer legal tags outbrain taboola".split()
)
#: Of these an article has its own, and frameworks use them for anything.
WEAK_NAMES = frozenset("header widget widgets legal search tags skip notification notifications alert".split())
#: What a weak name may belong to.
CONTENT_NAMES = frozenset("content article main post entry story body text title editor".split())
#: A class name that starts with one of these says what the page has, not what the element is.
STATES = frozenset("has with no without is not hide show toggle no-js js".split())

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its just like more my no not now of on one only or other our out over said she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur tout tu un une vous y "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat haben ich ihr im in ist ja kann man mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wenn wer wie wir wird zu zum zur "
    "al algo como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los mas más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya".split()
)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    dropped: bool = False
    article: int = 0  # number of the article or main element, 0 outside
    heading: bool = False
    text: str = ""
    label: str = ""


@dataclass(slots=True)
class Element:
    name: str
    dropped: bool
    article: int
    soft: bool  # dropped for a form only: an article inside counts again


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's class, id, role or state says that it isn't main text."""
    if not attributes or not attributes.strip():
        return False
    names: list[list[str]] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif key == "role":
            if value.strip().lower() in BOILERPLATE_ROLES:
                return True
        else:
            names += [[x.lower() for x in NAME_PART.findall(v)] for v in value.split()]
    if name in ("html", "body", "main"):
        return False
    for parts in names:
        found = set(parts) & (COMMENT_NAMES if name == "article" else BOILERPLATE_NAMES)
        if not found or parts[0] in STATES:
            continue
        if found - WEAK_NAMES or not in_article and not set(parts) & CONTENT_NAMES:
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, with what pass one needs."""
    out: list[Block] = []
    stack: list[Element] = []
    now = Block()
    links = articles = at = 0

    def close(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        top = stack[-1] if stack else None
        now = Block(dropped=bool(top and top.dropped), article=top.article if top else 0, heading=heading)

    def say(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            now.parts.append(text)
            if links:
                now.link_chars += len(text.strip())

    while m := TAG.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            elif any(e.name == name for e in stack):
                while stack and stack.pop().name != name:
                    pass
                close()
                continue
            if name in BLOCK:
                close()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>|\Z" if name != "head" else r"</head\b[^>]*>|(?=<body\b)|\Z", re.I).search(html, at)
            at = end.end()
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name == "a":
            links = 1  # links don't nest
        if name in BLOCK and stack and stack[-1].name == "p":
            stack.pop()
        top = stack[-1] if stack else None
        article = top.article if top else 0
        marked = _marked(name, m[3], bool(article))
        by_tag = name in BOILERPLATE_TAGS and not (name == "header" and article)
        if name in BLOCK or marked or by_tag:
            dropped, soft = bool(top and top.dropped), bool(top and top.soft)
            if name in ("article", "main"):
                if not article:
                    articles += 1
                    article = articles
                if soft and not marked:
                    dropped = soft = False
            if (marked or by_tag) and not dropped:
                dropped, soft = True, name == "form"
            if not m[3].endswith("/"):
                stack.append(Element(name, dropped, article, soft))
            close(heading=name in HEADING)
    last = html.rfind("<", at)
    say(html[at:last] if last >= 0 and CUT_OFF.match(html, last) else html[at:])
    close()
    return out


def _weight(text: str) -> float:
    """Length of a text, as if its script had spaces."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(WIDE_CHARACTER.findall(text))


def _stop_density(text: str) -> tuple[int, int]:
    words = [w for x in text.lower().split() if (w := NOT_LETTER.sub("", x))]
    return sum(w in STOP_WORDS for w in words), len(words)


def decide(found: list[Block]) -> None:
    """Labels every block "keep" or "drop": the two passes."""
    has_article = any(b.article and not b.dropped for b in found)
    stops = [_stop_density(b.text) for b in found]
    links = [b.link_chars / len(b.text) for b in found]
    prose = [s for b, s, x in zip(found, stops, links) if not b.dropped and x < 0.3]
    foreign = 20 * sum(s for s, _ in prose) < sum(n for _, n in prose)
    # Of links only, how many blocks stand together.
    run = [0] * len(found)
    for i in range(len(found)):
        run[i] = 0 if links[i] <= 0.5 else 1 + (run[i - 1] if i else 0)
    for i in range(len(found) - 2, -1, -1):
        run[i] = max(run[i], run[i + 1]) if run[i] and run[i + 1] else run[i]
    for i, (b, (stop_words, words), link) in enumerate(zip(found, stops, links)):
        size = _weight(b.text)
        stop = stop_words / words if words else 0.0
        if foreign and SENTENCE.search(b.text):
            stop = 0.25
        if b.dropped or not b.article and (has_article or RIGHTS.match(b.text)):
            b.label = "drop"
        elif link > 0.5:
            b.label = "" if b.article and run[i] < 3 else "drop"
        elif b.heading or size < 60:
            b.label = "drop" if link > 0.3 and not b.article else ""
        elif stop >= 0.25 or stop >= 0.12 and (size >= 150 or b.article):
            b.label = "keep"
        elif b.article or stop >= 0.05 or foreign:
            b.label = ""
        else:
            b.label = "drop"
    decided = [i for i, b in enumerate(found) if b.label]
    before: list[int | None] = []
    last = None
    for i, b in enumerate(found):
        before.append(last)
        last = i if b.label else last
    after: list[int | None] = [None] * len(found)
    last = None
    for i in range(len(found) - 1, -1, -1):
        after[i] = last
        last = i if found[i].label else last
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label:
            continue
        left, right = before[i], after[i]
        if b.article:  # neighbours of the same article only; without any, the container decides
            left = left if left is not None and found[left].article == b.article else None
            right = right if right is not None and found[right].article == b.article else None
            near = {labels[k] for k in (left, right) if k is not None}
            labels[i] = "drop" if near == {"drop"} and len(b.text) < 60 else "keep"
        elif left is None or right is None:
            k = left if right is None else right
            labels[i] = labels[k] if k is not None else "keep" if not decided and len(found) > 0 else "drop"
        elif labels[left] == labels[right]:
            labels[i] = labels[left]
        elif b.heading:
            labels[i] = labels[right]  # a heading goes with what it heads
        else:
            labels[i] = labels[left] if i - left < right - i else labels[right] if right - i < i - left else "keep"
    for b, label in zip(found, labels):
        b.label = label


def main_text(html: str) -> str:
    found = blocks(html)
    decide(found)
    return " ".join(b.text for b in found if b.label == "keep")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, size in by_bytes(batch.column(2), SLICE_BYTES, 256):
            part = batch.slice(low, size)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.large_string()).cast(pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row per page."""
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_block_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

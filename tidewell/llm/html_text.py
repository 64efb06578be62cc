"""Main text of web pages by two-pass block rules.

A page is read tag by tag into blocks. The first pass decides blocks by stop-word density, length and link density;
elements that say what they are (nav, footer, aside, form) decide theirs at once, and inside an article or main element
the bar for good text is lower. Stop words are of a few languages; on a page with hardly any of them length and link density
decide alone, and ideographs count twice. Short blocks without such evidence stay ambiguous. The second pass gives each of them
the label of its nearest decided neighbours in its own region, first the longer ones, which then are decided, then the short ones: the
common one if both agree, the only one if there is one, and otherwise what the region stands for.

Names of classes and ids are evidence. One that says nothing else (`ad`, `comment-list`, `sidebar`) makes its element boilerplate;
one that says it among other words (`content-sidebar-wrap`, `has-share-buttons`) leaves it to the rules, which then ask for good text
of some length. Neither counts for an article or main element, unless it is a reader's comment; a main element stands whatever it is in, unless
that is hidden, and an article stands in a form. Where no block of a page is good, its names are not believed, and it is read without them.

Scripts, styles, comments and other elements without running text are left out: those of raw text to the end of the page if
they are not closed, others then to the next block's tag or to where the same element opens again.
Character references are decoded, white space in a block becomes one space, blocks are joined by one newline in page
order; `br` is white space, two in a row end the block. Null or empty html gives an empty text. Each row gets a row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

# Elements by their role in a page.
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style iframe title textarea".split())
SKIPPED = RAW | frozenset("noscript template object svg math canvas select button audio video".split())
NESTED = frozenset("template object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Names by which elements say that they are no text of the page, those of reader comments among them, and words that such names may have
# beside them.
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments reply replies respond disqus discussion".split())
BESIDE = frozenset("a area bar block body bottom box btn button buttons container content-area count cta field first fixed footer-area form global header header-area icon icons id inner item items js last left link links list main-nav menu mobile outer panel primary region right row secondary section site slot small sticky thread title top tools unit wrap wrapper".split())
STOP = frozenset(
    (
        "the of and to in a is that it was for on are as with his they be at one have this from or had by but what all were when we there can an your which their said if do will how each them then she many some so these would into has more her two him see could no than been who its now did get may part i you he not our out up about over after"
        " de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux d l s n c mais comme on tout nous sa ses leur elle ils cette"
        " der die und das von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde"
        " el los las del y que se por con una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque no"
    ).split()
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BLUNT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_IDEOGRAPH = re.compile("[\u2e80-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


def _skipped(page: str, tag: str, at: int) -> int:
    """Where the page goes on behind an element without running text whose content begins here."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in NESTED:
            depth += 1
        elif tag not in RAW:
            break
        if not depth:
            close = page.find(">", m.end())
            return len(page) if close < 0 else close + 1
    if tag in RAW:
        return len(page)
    block = _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


@dataclass(frozen=True)
class Rules:
    """Lengths are code points; densities are shares of words (stop words) and of characters (links). stop_least: the share
    of stop words from which a page is in a language that has a list."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.2
    stop_least: float = 0.04
    links: float = 0.33
    short_in_main: int = 30


@dataclass
class Block:
    text: str
    linked: float
    kind: str
    region: int
    label: str = ""


@dataclass
class _Open:
    tag: str
    kind: str
    region: int
    inline: bool = field(default=False)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _is_hidden(attributes: dict[str, str]) -> bool:
    shown = attributes.get("hidden", "-").lower() in ("-", "false")
    return not shown or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def _named(attributes: dict[str, str], hints: frozenset[str]) -> str:
    """What class and id say: `whole` if one of their names says nothing but a hint, `part` if one says it among other words."""
    found = ""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_NAME.findall(name))
        if words & hints:
            if words <= hints | BESIDE:
                return "whole"
            found = "part"
    return found


def _kind(tag: str, text: str, inside: str, names: bool) -> str:
    """What an element makes of the blocks in it: hidden, boiler, form (as boiler, though an article may stand in it), weak, main, or what its parent
    makes of them."""
    attributes = _attributes(text) if text else {}
    if inside == "hidden" or _is_hidden(attributes):
        return "hidden"
    role = attributes.get("role", "").strip().lower()
    if tag == "main" or role == "main":
        return "main"
    if tag == "article" or role == "article":
        if inside == "boiler" or (names and _named(attributes, COMMENTS) == "whole"):
            return "boiler"
        return "main"
    if inside in ("boiler", "form"):
        return inside
    if tag == "form" or role in ("form", "search"):
        return "form"
    if tag in BOILER or role in ROLES or (tag == "header" and inside not in ("main", "weak")):
        return "boiler"
    said = _named(attributes, HINTS) if names and tag not in ("body", "html") else ""
    return "boiler" if said == "whole" else "weak" if said == "part" and inside in ("main", "weak") else inside


def blocks(page: str, names: bool = True) -> list[Block]:
    """The page's blocks in order. names: whether names of classes and ids are believed."""
    found: list[Block] = []
    stack = [_Open("", "plain", 0)]
    parts: list[str] = []
    linked = regions = breaks = links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, min(1.0, linked / len(text)), stack[-1].kind, stack[-1].region))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        parts.append(text)
        if text and not text.isspace():
            breaks = 0
            if links:
                linked += len(text.strip())

    while at < end:
        tag_at = page.find("<", at)
        if tag_at < 0:
            add(page[at:])
            break
        if tag_at > at:
            add(page[at:tag_at])
        if page.startswith("<!--", tag_at):
            close = page.find("-->", tag_at + 4)
            at = end if close < 0 else close + 3
            continue
        if page[tag_at + 1 : tag_at + 2] in ("!", "?"):
            close = page.find(">", tag_at)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, tag_at) or _BLUNT.match(page, tag_at)
        if not m:
            nxt = page[tag_at + 1 : tag_at + 2]
            if nxt == "/" or nxt.isalpha():  # a tag that the end of the page cuts off
                break
            add("<")
            at = tag_at + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in SKIPPED and not closing:
            if not attributes.endswith("/"):
                at = _skipped(page, tag, at)
            continue
        if tag not in BLOCK:
            within = stack[-1].inline and stack[-1].tag == tag  # one of the same name in a hidden one
            if not closing and tag not in VOID and not attributes.endswith("/") and (within or attributes and _is_hidden(_attributes(attributes))):
                flush()
                stack.append(_Open(tag, "hidden", stack[-1].region, True))
            elif closing and stack[-1].inline and stack[-1].tag == tag:
                flush()
                stack.pop()
            continue
        flush()
        breaks = 0
        if tag in VOID or tag == "p":
            if tag == "p" and not closing:
                links = 0
                while len(stack) > 1 and stack[-1].tag == "p":
                    stack.pop()
                if attributes:
                    stack.append(_Open("p", _kind("p", attributes, stack[-1].kind, names), stack[-1].region))
            elif tag == "p" and stack[-1].tag == "p":
                stack.pop()
            continue
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        kind = _kind(tag, attributes, stack[-1].kind, names)
        region = stack[-1].region
        if kind != stack[-1].kind:
            regions += 1
            region = regions
        stack.append(_Open(tag, kind, region))
    flush()
    return found


def _inherited(found: list[Block], which: str, has_main: bool) -> None:
    """Give the blocks of that label the label of their nearest decided neighbours."""
    before: list[str] = []
    after: list[str] = [""] * len(found)
    seen: dict[int, str] = {}
    for b in found:
        before.append(seen.get(b.region, ""))
        if b.label in ("good", "bad"):
            seen[b.region] = b.label
    seen = {}
    for k in range(len(found) - 1, -1, -1):
        after[k] = seen.get(found[k].region, "")
        if found[k].label in ("good", "bad"):
            seen[found[k].region] = found[k].label
    for k, b in enumerate(found):
        if b.label == which:
            sides = {before[k], after[k]} - {""}
            stands = "good" if b.kind == "main" or (which == "near" and not has_main) else "bad"
            b.label = sides.pop() if len(sides) == 1 else stands


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    # A main element with hardly any text is no reason to doubt what stands beside it.
    has_main = sum(len(b.text) for b in found if b.kind == "main") >= rules.long
    every = [_WORD.findall(b.text.lower()) for b in found]
    stops = [sum(w in STOP for w in words) for words in every]
    unlisted = sum(stops) < rules.stop_least * sum(map(len, every))
    for b, words, stop in zip(found, every, stops, strict=True):
        density = rules.stop_high if unlisted else stop / len(words) if words else 0.0
        size = len(b.text) + len(_IDEOGRAPH.findall(b.text))
        if b.kind in ("hidden", "boiler", "form") or b.linked > rules.links or "\N{COPYRIGHT SIGN}" in b.text and size < rules.long and b.kind != "main":
            b.label = "bad"
        elif b.kind == "main":
            b.label = "good" if size >= rules.short_in_main else "short"
        elif b.kind == "weak":
            b.label = "good" if size >= rules.short and density >= rules.stop_low else "bad"
        elif size < rules.short:
            b.label = "bad" if b.linked or has_main else "short"
        elif density >= rules.stop_high:
            b.label = "good" if size > rules.long and not has_main else "near"
        elif density >= rules.stop_low:
            b.label = "near"
        else:
            b.label = "bad"
    _inherited(found, "near", has_main)
    _inherited(found, "short", has_main)
    return found


def main_text(page: str, rules: Rules = Rules()) -> str:
    for names in (True, False):
        good = [b.text for b in classify(blocks(page, names), rules) if b.label == "good"]
        if good:
            break
    return "\n".join(good)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), rules) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    asked = common.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return asked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))

"""Listing pages and documents read from page trees.

A page becomes its text and an array of those of its nodes that a selector picks, in document order, each with the place of its last
descendant: `x` lies in `y` if y.pos < x.pos <= y.last. One Arrow pass makes the arrays, resolves links and notes of each node what it is
(`marks`, a bit a selector), which part of the text it says and which card and link are nearest around it; everything else is expressions
over them: the descendants of an element are a slice, its text is a substring, and a selector is a bit. So a page is read once, however many
cards it has. Cards of all pages are then rows, ranked by windows; a page is the largest group.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.sources.urls import canonical, canonical_or_none

NODE = "struct<pos:int,last:int,marks:int,card:int,url:string,start:int,stop:int,box:int,link:int,attrs:map<string,string>>"
ITEM = "struct<title:string,url:string,item_id:string,published:string,summary:string,body:string>"
FIELDS = ("title", "url", "item_id", "published", "summary", "body")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that a tag of the same group closes, as markup may leave their ends out.
CLOSED_BY = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
MOST_SUMMARY = 500
# Elements whose content is never read.
ACTIVE_TAGS = ("script", "style", "noscript", "template", "form", "iframe", "object", "embed")
EPOCH = datetime(1970, 1, 1)
#: Markup as it is mostly written: an end, a start with values in quotes, a comment, a document type. HTMLParser reads it in the same way.
_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
MARKUP = re.compile(rf"""</({_NAME})\s*>|<({_NAME})((?:[ \t\n\r\f]+[^\s"'<>/=\x00]+(?:="[^"]*"|='[^']*')?)*)[ \t\n\r\f]*(/?)>|<!--.*?--\s*>|<!(?i:doctype)[^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=\x00]+)(?:=(?:"([^"]*)"|'([^']*)'))?""")
RAW_END = {tag: re.compile(rf"</\s*{tag}\s*>", re.I) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


class _Reader(HTMLParser):
    """Nodes of a page: elements, and texts as nodes without a tag."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.nodes, self.open = base, [], []
        self.dead, self.counts = 0, defaultdict(int)
        self._add("#root", {}, None, None)
        self.open.append(0)

    def _add(self, tag: str, attrs: dict[str, str], url: str | None, text: str | None) -> int:
        at = len(self.nodes)
        self.nodes.append([at, at, tag, attrs, url, text, self.dead > 0])
        return at

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        node[1] = len(self.nodes) - 1
        self.dead -= node[2] in ACTIVE_TAGS
        self.counts[node[2]] -= 1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY:
            while len(self.open) > 1 and self.nodes[self.open[-1]][2] in CLOSED_BY[tag]:
                self._close()
        held = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        link = held.get("href", "") if tag in ("a", "link") else held.get("content", "") if tag == "meta" and held.get("property") == "og:url" else ""
        self.dead += tag in ACTIVE_TAGS
        at = self._add(tag, held, canonical_or_none(link, self.base) if link.strip() else None, None)
        self.open.append(at)
        self.counts[tag] += 1
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.counts[tag] and tag not in VOID:
            while self.nodes[self.open[-1]][2] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if data.strip():
            self._add("", {}, None, data)

    def read(self, html: str) -> list[list]:
        """The nodes of a page. Markup is read here as long as it is plain, what is left by HTMLParser."""
        at, size = 0, len(html)
        while at < size:
            begins = html.find("<", at)
            if begins < 0:
                break
            if begins > at:
                self.handle_data(unescape(html[at:begins]))
            at = begins
            m = MARKUP.match(html, at)
            if not m:
                break
            end, tag, attrs, empty = m.groups()
            if end:
                self.handle_endtag(end.lower())
            elif tag:
                tag = tag.lower()
                raw = RAW_END[tag].search(html, m.end()) if tag in RAW_END and not empty else None
                if tag in RAW_END and not empty and not raw:
                    break
                (self.handle_startendtag if empty else self.handle_starttag)(tag, [(k.lower(), unescape(v or w)) for k, v, w in ATTRIBUTE.findall(attrs)] if attrs else ())
                if raw:
                    self.handle_data(html[m.end() : raw.start()])
                    self.handle_endtag(tag)
                    m = raw
            at = m.end()
        self.feed(html[at:])
        return self.ended()

    def ended(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.nodes


def tree(html: str, base: str) -> list[list]:
    return _Reader(base).read(html)


def item(**x: str | None) -> dict[str, str | None]:
    """An item; its summary is how its body begins."""
    made = dict.fromkeys(FIELDS, "")
    for k, v in x.items():
        if k == "body":
            made[k] = v or ""
        elif v is not None and v != "":
            made[k] = " ".join(str(v).split())
    made["summary"] = made["summary"] or made["body"][:MOST_SUMMARY]
    return made


def html_text(raw: str | None) -> str:  # S15
    raw = raw or ""
    if "<" not in raw:
        return " ".join(unescape(raw).split())
    return " ".join(" ".join(n[5] for n in tree(raw, "") if n[5] is not None and not n[6]).split())


def said(record, names: tuple[str, ...]) -> str:
    """The first value of those names that says something."""
    return next((str(record[n]) for n in names if record.get(n) not in (None, "", [], {})), "") if isinstance(record, dict) else ""


def breadth_first(x, wanted: Callable) -> Iterator:
    """What `wanted` gives for each mapping within x, outer ones first."""
    level = [x]
    while level:
        yield from (found for m in level if isinstance(m, dict) and (found := wanted(m)) is not None)
        level = [v for m in level if isinstance(m, dict | list) for v in (m.values() if isinstance(m, dict) else m)]


def linked_dates(nodes: list[list]) -> list[str]:  # SC11
    """Every `datePublished` in the page's linked data, script by script, outer ones first."""
    out = []
    for node in nodes:
        if node[2] == "script" and node[3].get("type") == "application/ld+json":
            try:
                held = json.loads("".join(n[5] for n in nodes[node[0] + 1 : node[1] + 1] if n[5] is not None))
            except ValueError:
                continue
            out += [str(x) for x in breadth_first(held, lambda m: m.get("datePublished") or None)]
    return out


def registry(html: str) -> list | None:  # SC12
    """The first `article_list` of the data that a page hands to its router, outer ones first."""
    m = re.search(r"window\._ROUTER_DATA\s*=\s*(\{.*?\})\s*</script>", html, re.S)
    try:
        held = json.loads(m[1]) if m else None
    except ValueError:
        return None
    return next(breadth_first(held, lambda x: x["article_list"] if isinstance(x.get("article_list"), list) else None), None)


def instant(at) -> str:
    """The instant of so many milliseconds, empty for what is none."""
    if type(at) is int and abs(at) < 9 * 10**12:
        return f"{EPOCH + timedelta(milliseconds=at):%Y-%m-%dT%H:%M:%SZ}"
    day = pd.to_datetime(at, unit="ms", utc=True, errors="coerce") if isinstance(at, int | float) else pd.NaT
    return "" if day is pd.NaT else day.strftime("%Y-%m-%dT%H:%M:%SZ")


def router_items(given: list, base: str) -> list[dict]:  # SC12
    """Items of a registry's records, each with its ArticleMeta and the content of the base's language."""
    language = "zh" if "/zh/" in urlsplit(base).path else "en"
    out = []
    for r in (x for x in given if isinstance(x, dict)):
        meta, content = r.get("ArticleMeta"), r.get(f"ArticleSubContent{language.title()}")
        if not isinstance(meta, dict) or not isinstance(content, dict):
            continue
        title, slug, at = html_text(said(content, ("Title",))), said(content, ("TitleKey",)).strip(), meta.get("PublishDate")
        if title and slug:
            url = canonical(f"/{language}/blog/{quote(slug)}", base)
            out.append(item(title=title, url=url, item_id=said(meta, ("ArticleID",)) or url, published=instant(at), body=html_text(said(content, ("Abstract",))) or title))
    return out


def _routed(html: str, base: str) -> list[dict]:
    try:
        return router_items(registry(html) or [], base)
    except ValueError:  # a base without a host
        return []


# What marks cards, dates and titles in newsrooms. Each test is of a tag, its attributes and its class.
CARDS = (
    lambda tag, attrs, c: tag == "article",
    *((lambda tag, attrs, c, piece=piece: piece in c) for piece in ("press-release", "news-card", "post-card", "release-card")),
    *((lambda tag, attrs, c, name=name: name in c and name in re.split(r"[ \t\n\x0b\f\r]+", c)) for name in ("cards__card", "article-short-card", "caption")),
    *((lambda tag, attrs, c, piece=piece: tag == "li" and piece in c and "data-variants" in attrs) for piece in ("CardContent", "CardFeature")),
)
DATE_METAS = (("property", "article:published_time"), ("name", "datePublished"), ("name", "date_published"), ("name", "publish-date"), ("itemprop", "datePublished"))
CARD_LIKE, TITLE_LIKE = re.compile("card|item|slide|resource|featured", re.I | re.A), re.compile("title|headline", re.I | re.A)
#: Attributes whose values are read.
READ = ("datetime", "content", "data-date", "data-title", "data-date-start", "data-date-published", "data-id")
# Bits of `marks`: the first row are of live elements, the others of all. BOX looks like a card and says enough, or names its title.
HEADING, TITLED, DATED, TIME, ANCHOR, MAIN, ARTICLE, BODY, BOX = (1 << k for k in range(9))
DATA_TITLE, DATE_START, DATE_PUBLISHED, OG_TITLE, CARD_TITLE, OG_URL, OG_DESCRIPTION, DESCRIPTION, H1, TITLE, CANONICAL = (1 << k for k in range(9, 20))
BY_TAG = {"h1": HEADING, "h2": HEADING, "h3": HEADING, "h4": HEADING, "time": TIME, "main": MAIN, "article": ARTICLE, "body": BODY}
ANYWHERE = {"h1": H1, "title": TITLE}
#: Elements that a selector may pick without an attribute of theirs; another one only as a box around titles in attributes.
TELLING = BY_TAG.keys() | ANYWHERE.keys()
METAS = {("property", "og:title"): OG_TITLE, ("name", "twitter:title"): CARD_TITLE, ("property", "og:url"): OG_URL, ("property", "og:description"): OG_DESCRIPTION, ("name", "description"): DESCRIPTION}
HELD = {"data-title": DATA_TITLE, "data-date-start": DATE_START, "data-date-published": DATE_PUBLISHED}
LEAST_TEXT, LEAST_TITLE, MOST_BODY, MOST_TITLE = 15, 8, 5_000, 160
#: Pages that leave the pass together, and the characters after which a batch ends (a longer page goes alone).
PAGES, CHARACTERS = 256, 1 << 20
#: White space as the expressions' `collapse` has it.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def collapsed(text: str) -> str:
    """White space as one blank, none at either end. The only white space that is printable is a blank."""
    return (text if text.isprintable() and "  " not in text else BLANKS.sub(" ", text)).strip(" ")


def _marks(tag: str, attrs: dict[str, str], dead: bool) -> int:
    out = ANYWHERE.get(tag, 0)
    if not attrs:
        return out if dead else out | BY_TAG.get(tag, 0)
    for name, bit in HELD.items():
        out |= bit * (name in attrs)
    if tag == "meta":
        for (name, value), bit in METAS.items():
            out |= bit * (attrs.get(name) == value)
    elif tag == "link":
        out |= CANONICAL * (attrs.get("rel") == "canonical")
    if dead:
        return out
    c = attrs.get("class", "")
    dated = "data-date" in attrs or ("date" in c or "publish" in c or "timestamp" in c)
    return out | BY_TAG.get(tag, 0) | TITLED * bool(c and TITLE_LIKE.search(c)) | DATED * dated | ANCHOR * (tag == "a" and "href" in attrs)


def noted(nodes: list[list]) -> tuple[list[tuple], str]:
    """The nodes that a selector picks, and the root, by the fields of NODE and numbered anew; and the text of the page."""
    pieces, begins, ends, titles, length, named = [], [-1] * len(nodes), [], [], 0, 0
    for pos, _, _, attrs, _, said, dead in nodes:  # by node: where live text begins from it on (made below), where it has ended so far, and titles in attributes so far
        if said is not None and not dead:
            pieces.append(collapsed(said))
            begins[pos] = length + (len(pieces) > 1)
            length = begins[pos] + len(pieces[-1])
        ends.append(length)
        named += "data-title" in attrs
        titles.append(named)
    after = length
    for k in range(len(nodes) - 1, -1, -1):
        after = begins[k] = begins[k] if begins[k] >= 0 else after
    out, places, around = [], [], []
    for pos, last, tag, attrs, url, _, dead in nodes:
        if pos and (not tag or (not attrs and tag not in TELLING and titles[last] == titles[pos])):
            places.append(len(out) - 1)
            continue
        kept = pos == 0
        if pos:
            start, stop = begins[pos], max(begins[pos], ends[last])
            marks, c, titled = _marks(tag, attrs, dead), attrs.get("class", ""), titles[last] > titles[pos]
            if not dead and tag not in ("body", "html") and (titled or (stop - start >= LEAST_TEXT and (attrs.get("role") == "listitem" or (c and CARD_LIKE.search(c))))):
                marks |= BOX
            card = next((k for k, test in enumerate(CARDS) if test(tag, attrs, c)), None) if (c or tag == "article") and not dead else None
            kept = marks or card is not None
        else:
            start, stop, marks, card = 0, length, 0, None
        if kept:
            while around and around[-1][0] < pos:
                around.pop()
            box, link = around[-1][1:] if around else (None, None)
            at = len(out)
            out.append([at, last, marks, card, url, start, stop, box, link, [(k, attrs[k]) for k in READ if k in attrs] if attrs else []])
            around.append((last, at if marks & BOX else box, at if marks & ANCHOR else link))
        places.append(len(out) - 1)
    for n in out:
        n[1] = places[n[1]]
    return out, " ".join(pieces)


def told_dates(nodes: list[list]) -> list[str]:  # SC11
    """What the page's metadata say of its date, the first element of each kind, then its linked data."""
    metas = [n[3] for n in nodes if n[2] == "meta"]
    said = [next((m for m in metas if m.get(name) == value), {}) for name, value in DATE_METAS]
    return [x for m in said if (x := m.get("content") or m.get("datetime"))] + linked_dates(nodes)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = pa.struct([(n, pa.int32()) for n in ("pos", "last", "marks", "card")] + [("url", pa.string())] + [(n, pa.int32()) for n in ("start", "stop", "box", "link")] + [("attrs", pa.map_(pa.string(), pa.string()))])
    item_ = pa.struct([(f, pa.string()) for f in FIELDS])

    def listed(lists: list[list], fields: list[pa.Array], kind: pa.StructType) -> pa.ListArray:
        offsets = pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind)))

    def made(rows: pa.RecordBatch, read: list[tuple]) -> pa.RecordBatch:
        nodes, texts, dates, routed = map(list, zip(*read, strict=True))
        by_field = list(zip(*(n for x in nodes for n in x), strict=True)) or [()] * len(node)
        said = [x for r in routed for x in r]
        columns = [listed(nodes, [pa.array(v, f.type) for v, f in zip(by_field, node, strict=True)], node), pa.array(texts, pa.string()), pa.array(dates, pa.list_(pa.string())), listed(routed, [pa.array([x[f] for x in said], pa.string()) for f in FIELDS], item_)]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, "nodes", "page_text", "dates", "routed"])

    for batch in batches:
        read, began, held = [], 0, 0
        for k, (html, base) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("payload", "url")), strict=True)):
            html, base = html or "", base or ""
            if read and (len(read) == PAGES or held + len(html) > CHARACTERS):
                yield made(batch.slice(began, len(read)), read)
                read, began, held = [], k, 0
            routed = _routed(html, base) if "_ROUTER_DATA" in html else []
            nodes = tree(html, base) if not routed else []
            read.append((*(noted(nodes) if nodes else ([], "")), told_dates(nodes), routed))
            held += len(html)
        if read:
            yield made(batch.slice(began, len(read)), read)


def trees(payloads: DataFrame) -> DataFrame:
    """payloads (…, url, payload) with the noted nodes of each page, its text, the dates that its metadata and linked data tell, and the
    items of a router's registry where it has one (then the page is not read). Pages leave in bounded batches, a long one alone."""
    kept = [f for f in payloads.schema if f.name != "payload"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.drop_columns("payload") for b in _trees(batches))

    return payloads.mapInArrow(run, f"{shape}, nodes array<{NODE}>, page_text string, dates array<string>, routed array<{ITEM}>")


# What expressions say of nodes. A node's places refer to the page's array, less the `start` nodes before the one at hand.


def inner(within: Column, n: Column, start: Column | int = 0) -> Column:
    """The descendants of n."""
    return F.slice(within, n["pos"] - start + 2, n["last"] - n["pos"])


def own(nodes: Column, n: Column) -> Column:
    """n and its descendants."""
    return F.slice(nodes, n["pos"] + 1, n["last"] - n["pos"] + 1)


def words(text: Column, n: Column, start: Column | int = 0) -> Column:  # S15
    """What n says, white space as one blank; `text` begins at `start` of the page's."""
    return F.substring(text, n["start"] - start + 1, n["stop"] - n["start"])


def first(nodes: Column, mark: int) -> Column:
    return F.get(F.filter(nodes, lambda n: n["marks"].bitwiseAND(mark) != 0), F.lit(0))


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


# The paths of articles, and titles that say nothing.
ARTICLE_PATH = r"(?i)/(?:blog|articles?|news|newsroom|press-releases?|posts|research)/[^/?#]+"
GENERIC = ("news", "newsroom", "blog", "articles")


def parsed(c: Column) -> Column:
    """The text, if it is a date."""
    return tx.let(c, lambda x: F.when(tx.parse_lenient_time(x).isNotNull(), x))


def time_of(n: Column, said: Column) -> Column:
    return filled(attr(n, "datetime"), said)


def told_date(n: Column, said: Column) -> Column:
    """The date that an element marked as one gives: an attribute's, or its text's."""
    return tx.date_hint(filled(attr(n, "datetime"), attr(n, "content"), attr(n, "data-date"), said))


def with_date(read: DataFrame) -> DataFrame:  # SC11
    """Pages of trees() with `dated`: metadata first, then linked data, then what the article says itself: a time, a marked date, a date in its prose."""
    nodes, text, article = F.col("nodes"), F.col("page_text"), F.col("_article")
    out = read.withColumn("_article", F.coalesce(first(nodes, ARTICLE), first(nodes, MAIN))).withColumn("_own", inner(nodes, article))
    out = out.withColumns({"_time": first(F.col("_own"), TIME), "_marked": first(F.col("_own"), DATED)})
    told = F.get(F.filter(F.transform("dates", parsed), lambda x: x.isNotNull()), F.lit(0))
    time, marked = (f(F.col(c), words(text, F.col(c))) for f, c in ((time_of, "_time"), (told_date, "_marked")))
    return out.withColumn("dated", F.coalesce(told, parsed(time), marked, tx.date_hint(words(text, article)))).drop("_article", "_own", "_time", "_marked")


def main_of(nodes: Column, *marks: int) -> Column:
    """The first element of the first mark that occurs, the page itself if none does."""
    return F.coalesce(*(first(nodes, m) for m in marks), F.get(nodes, F.lit(0)))


def documents(read: DataFrame) -> DataFrame:  # SC11
    """Each page of trees() as one document: title, canonical URL, date, body. Null fields where a page has no title."""
    nodes, text = F.col("nodes"), F.col("page_text")
    found = {"_og": OG_TITLE, "_card": CARD_TITLE, "_h1": H1, "_title": TITLE, "_canonical": CANONICAL, "_url": OG_URL, "_said": OG_DESCRIPTION, "_description": DESCRIPTION}
    out = with_date(read).withColumns({k: first(nodes, m) for k, m in found.items()} | {"_main": main_of(nodes, MAIN, ARTICLE, BODY)})
    og, card, h1, title, canonical_, url, said, description, main = (F.col(c) for c in (*found, "_main"))
    named = F.when(og.isNotNull(), attr(og, "content")).when(card.isNotNull(), attr(card, "content")).when(h1.isNotNull(), words(text, h1)).otherwise(words(text, title))
    described = filled(attr(said, "content"), attr(description, "content"))
    out = out.withColumns({"title": F.nullif(tx.collapse(named), F.lit("")), "published": F.col("dated"), "_described": tx.collapse(described)})
    out = out.withColumn("body", filled(words(text, main), F.col("_described"), F.col("title")))
    return out.withColumn("url", F.coalesce(canonical_["url"], url["url"], F.col("base"))).withColumn("item_id", F.col("url")).withColumn("summary", F.substring("body", 1, MOST_SUMMARY)).drop("nodes", "page_text", "dates", "routed", "dated", "_described", *found, "_main")


def _picked(nodes: Column, text: Column, base: Column, routed: Column) -> Column:
    """Cards by selector, anchors of articles on the page's own host, and the page itself: each with its own nodes and text, the link around it
    and, for an anchor of few words, the nodes and text of the nearest card around it. Items of a router are as they are."""
    none, silent, node = F.lit(None).cast(f"array<{NODE}>"), F.lit(None).cast("string"), F.lit(None).cast(NODE)

    def entry(kind: str, number: Column, n: Column, outer: Column, box: Column | None = None) -> Column:
        around = (none, silent) if box is None else (own(nodes, box), words(text, box))
        return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"), n["pos"].alias("pos"), n.alias("n"), own(nodes, n).alias("own"), words(text, n).alias("said"), outer.alias("outer"), around[0].alias("box"), around[1].alias("boxed"), F.lit(None).cast(ITEM).alias("given"))

    cards = F.transform(F.filter(nodes, lambda n: n["card"].isNotNull()), lambda n: entry("card", n["card"], n, F.get(nodes, n["link"])))
    here = lambda n: (n["marks"].bitwiseAND(ANCHOR) != 0) & n["url"].isNotNull() & (tx.url_host(n["url"]) == tx.url_host(base)) & F.regexp_extract(n["url"], r"^[^:]+://[^/?#]*([^?#]*)", 1).rlike(ARTICLE_PATH)
    box = lambda n: F.when(n["stop"] - n["start"] < LEAST_TEXT, F.get(nodes, n["box"]))
    links = F.transform(F.filter(nodes, here), lambda n: tx.let(box(n), lambda b: entry("link", F.lit(len(CARDS)), n, n, b)))
    page = F.filter(F.array(main_of(nodes, MAIN, ARTICLE, BODY)), lambda n: n.isNotNull())
    given = F.transform(routed, lambda x, k: F.struct(F.lit("routed").alias("kind"), F.lit(0).alias("number"), k.alias("pos"), node.alias("n"), none.alias("own"), silent.alias("said"), node.alias("outer"), none.alias("box"), silent.alias("boxed"), x.alias("given")))
    return F.concat(cards, links, F.transform(page, lambda n: entry("page", F.lit(len(CARDS) + 1), n, node)), given)


def cards(read: DataFrame, key: list[str]) -> DataFrame:  # SC10, W4
    """Items of the listing pages of trees() (key…, base, max_items, …): rows (key…, n, title, url, item_id, published, summary, body),
    the best one of a URL, in order of first sight. A page without cards is its own item; one that says nothing is a row without an item."""
    c = F.col
    rows = with_date(read).select(*key, "base", "max_items", "dated", F.explode_outer(_picked(c("nodes"), c("page_text"), c("base"), c("routed"))).alias("x"))
    rows = rows.select(*key, "base", "max_items", "dated", "x.*").withColumn("inside", F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0)))).withColumn("below", F.slice("box", F.lit(2), F.greatest(F.size("box") - 1, F.lit(0))))
    pos, start, is_link, routed = c("pos"), c("n")["start"], c("kind") == "link", c("kind") == "routed"
    # Cards: a heading or what is classed as one names them; its own link comes before another inside and the one around.
    rows = rows.withColumns({"head": first(c("inside"), HEADING), "near": F.when(is_link, first(c("below"), HEADING)), "box_start": F.get("box", F.lit(0))["start"]} | {f"_{k}": F.when(~is_link, first(c("inside"), m)) for k, m in (("titled", TITLED), ("anchor", ANCHOR), ("time", TIME), ("marked", DATED))})
    rows = rows.withColumn("heading", F.coalesce("head", "_titled"))
    rows = rows.withColumns({"linked": F.when(~is_link, F.coalesce(first(inner(c("own"), c("heading"), pos), ANCHOR), c("_anchor"), c("outer"))), "named": filled(words(c("said"), c("heading"), start))})
    # Anchors: the card around one of few words gives text, title and date.
    rows = rows.withColumn("body", F.when(is_link & (F.length("said") < LEAST_TEXT), F.coalesce("boxed", F.lit(""))).otherwise(c("said")))
    held = lambda mark, name: attr(first(c("below"), mark), name)
    shown = F.when(c("head").isNotNull(), words(c("said"), c("head"), start)).otherwise(words(c("boxed"), c("near"), c("box_start")))
    day = F.coalesce(held(DATE_START, "data-date-start"), held(DATE_PUBLISHED, "data-date-published"))
    title = F.when(is_link, filled(held(DATA_TITLE, "data-title"), shown, tx.card_title(c("body")))).otherwise(F.coalesce("named", F.substring("body", 1, MOST_TITLE)))
    url = F.when(is_link, c("n.url")).when(c("linked").isNull(), c("base")).otherwise(c("linked.url"))
    own_date = F.coalesce(*(f(c(k), words(c("said"), c(k), start)) for f, k in ((time_of, "_time"), (told_date, "_marked"))), tx.date_hint(c("body")))
    published = F.when(is_link, parsed(tx.date_hint(filled(day, c("body"))))).otherwise(own_date)
    of = lambda name, x: F.when(routed, c(f"given.{name}")).otherwise(x)
    rows = rows.withColumns({"title": of("title", title), "url": of("url", url), "published": of("published", published), "with_heading": c("head").isNotNull() | c("near").isNotNull(), "body": of("body", c("body"))})
    rows = rows.withColumn("item_id", of("item_id", F.when(~is_link, filled(attr(c("n"), "data-id")))))
    sound = c("url").isNotNull() & (F.coalesce("title", F.lit("")) != "") & (c("body") != "") & (~is_link | ((F.length("body") >= LEAST_TEXT) & (F.length("title") >= LEAST_TITLE)))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.select(*key, "max_items", "dated", "kind", "number", "pos", "title", "url", F.coalesce("item_id", "url").alias("item_id"), "published", "with_heading", "sound", F.when(is_link, F.substring("body", 1, MOST_BODY)).otherwise(c("body")).alias("body"))
    rows = rows.withColumn("has_date", c("published").isNotNull() & tx.parse_lenient_time(c("published")).isNotNull()).repartition(*key)
    # Anchors of one URL compete first, by date, heading and length of text; what is left competes with the cards, by date and title.
    has_date = F.col("has_date")
    page, by_url = Window.partitionBy(*key), Window.partitionBy(*key, "kind", "sound", "url")
    quality = F.when(has_date, 10_000).otherwise(0) + F.when(F.col("with_heading"), 2_000).otherwise(0) + F.least(F.length("body"), F.lit(1_000))
    rows = rows.withColumn("quality", F.when(is_link, quality).otherwise(0)).withColumn("place", F.when(is_link, F.min("pos").over(by_url)).otherwise(F.col("pos")))
    rows = rows.withColumn("nth", F.row_number().over(by_url.orderBy(F.desc("quality"), "pos"))).where(~F.coalesce(is_link, F.lit(False)) | (F.col("nth") == 1))
    rows = rows.withColumn("others", F.count_if(F.col("sound") & (F.col("kind") != "page")).over(page)).withColumn("kept", F.col("sound") & ((F.col("kind") != "page") | (F.col("others") == 0)))
    rows = rows.withColumn("published", F.when((F.greatest("others", F.lit(1)) == 1) & F.col("dated").isNotNull(), F.col("dated")).otherwise(F.col("published")))
    order, whole = F.struct("number", "place"), Window.partitionBy(*key, "kept", "url", F.when(F.col("kind") == "routed", F.col("pos")))
    score = F.when(has_date, 10_000).otherwise(0) + F.when(F.lower(F.trim("title")).isin(*GENERIC), 0).otherwise(5_000) + F.least(F.length("title"), F.lit(1_000))
    rows = rows.withColumn("order", order).withColumn("score", score).withColumn("seen", F.min("order").over(whole))
    rows = rows.withColumn("nth", F.row_number().over(whole.orderBy(F.desc("score"), "order"))).where("nth = 1")
    rows = rows.withColumn("n", F.row_number().over(page.orderBy(F.desc("kept"), "seen")) - 1)
    rows = rows.where((F.col("kept") & (F.col("n") < F.col("max_items"))) | (~F.col("kept") & (F.col("n") == 0)))
    held = lambda c: F.when(F.col("kept"), c)
    return rows.select(*key, held(F.col("n")).alias("n"), *(held(F.col(c)).alias(c) for c in ("title", "url", "item_id", "published")), held(F.substring("body", 1, MOST_SUMMARY)).alias("summary"), held(F.col("body")).alias("body"))

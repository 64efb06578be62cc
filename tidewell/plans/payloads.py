"""Queries that run the payload parsers over payloads made of the rows of `part`, one of each kind a row, so that SQL can
state the items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.plans.registry import query, table
from tidewell.sources import candidates as cd
from tidewell.sources import parsers

#: Lane, payload, and the items it holds by column; {name} and {key} stand for the row's own.
KINDS: dict[str, tuple[str, str, list[dict[str, str]]]] = {
    "feed_items": (  # SC7, S15, S16
        "rss_atom",
        "<!DOCTYPE rss [<!ENTITY x 'y'>]><rss><channel><title>All parts</title><item><title>{name} &amp;  more</title><link>https://base.example/p/{key}?utm_source=x&amp;b=1&amp;a=2</link><guid>g{key}</guid><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;About &lt;b&gt;{name}&lt;/b&gt;&lt;/p&gt;</description></item><item><title>Nowhere else</title></item><item><description>no title</description></item><item><title>Second&nbsp;{key}</title><guid>/q/{key}</guid></item></channel></rss>",
        [
            {"title": "{name} & more", "url": "https://base.example/p/{key}?a=2&b=1", "item_id": "g{key}", "published": "Tue, 05 Mar 2024 10:00:00 +0000", "body": "About {name}"},
            {"title": "Nowhere else", "url": "https://base.example/list", "item_id": "https://base.example/list", "body": "Nowhere else"},
            {"title": "Second {key}", "url": "https://base.example/q/{key}", "item_id": "/q/{key}", "body": "Second {key}"},
        ],
    ),
    "atom_items": (  # SC7
        "rss_atom",
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>{name}</title><link rel="self" href="/self"/><link href="/e/{key}"/><id>tag:{key}</id><updated>2024-03-05T00:00:00Z</updated><content>&lt;i&gt;Long&lt;/i&gt; text</content><summary>Short</summary></entry></feed>',
        [{"title": "{name}", "url": "https://base.example/e/{key}", "item_id": "tag:{key}", "published": "2024-03-05T00:00:00Z", "body": "Long text"}],
    ),
    "api_items": (  # SC8, SC15
        "api",
        '{"total": 3, "results": [{"headline": "{name}", "link": "/p/{key}", "id": {key}, "publishedAt": "2024-01-02", "content": "<p>x <b>{name}</b></p>"}, {"title": "", "url": "/none"}, 3, {"title": "Other", "href": "https://other.example:443//a//b", "extra": {"introduction": "In {key}", "date": "2024-02-02"}}, {"name": "Nowhere else"}]}',
        [
            {"title": "{name}", "url": "https://base.example/p/{key}", "item_id": "{key}", "published": "2024-01-02", "body": "x {name}"},
            {"title": "Other", "url": "https://other.example/a/b", "item_id": "https://other.example:443//a//b", "published": "2024-02-02", "body": "In {key}"},
            {"title": "Nowhere else", "url": "https://base.example/list", "item_id": "https://base.example/list", "body": "Nowhere else"},
        ],
    ),
    "release_items": (  # SC8: containers within containers
        "api",
        '{"data": {"releases": [{"form": "Release of {name}", "documentNumber": "D-{key}", "html_url": "/r/{key}", "acceptanceDateTime": "2024-03-01T10:00:00Z", "abstract": "A {name}"}]}, "newsList": [{"title": "never read"}]}',
        [{"title": "Release of {name}", "url": "https://base.example/r/{key}", "item_id": "D-{key}", "published": "2024-03-01T10:00:00Z", "body": "A {name}"}],
    ),
    "news_list_items": (  # SC8
        "api",
        '{"total": 1, "newsList": [{"title": "{name} grows", "link": "/news/{key}/", "date": "17 February 2024"}]}',
        [{"title": "{name} grows", "url": "https://base.example/news/{key}/", "item_id": "/news/{key}/", "published": "17 February 2024", "body": "{name} grows"}],
    ),
    "columnar_items": (  # SC9 in payloads
        "api",
        '{"filings": {"recent": {"accessionNumber": ["{key}", "2"], "form": ["8-K", "10-Q"], "primaryDocument": ["f{key}.htm", "second.htm"], "filingDate": ["2024-01-01"]}}}',
        [
            {"title": "f{key}.htm", "url": "https://base.example/list", "item_id": "{key}", "published": "2024-01-01", "body": "f{key}.htm"},
            {"title": "second.htm", "url": "https://base.example/list", "item_id": "2", "body": "second.htm"},
        ],
    ),
    "listing_items": (  # SC10, W4: anchors as cards
        "html",
        '<div><a href="/news/{key}">Read more</a></div><a href="/news/{key}"><h3>The headline of {name}</h3> March 5, 2024</a><a href="/">Home page of all</a><a href="/about-us">About all of us here</a><a href="https://else.example/news/x">Others have headlines too</a><a href="/news/x">Second headline here</a>',
        [
            {"title": "The headline of {name}", "url": "https://base.example/news/{key}", "item_id": "https://base.example/news/{key}", "published": "March 5, 2024", "body": "The headline of {name} March 5, 2024"},
            {"title": "Second headline here", "url": "https://base.example/news/x", "item_id": "https://base.example/news/x", "body": "Second headline here"},
        ],
    ),
    "overlay_items": (  # SC10: empty anchors over cards
        "html",
        '<main><div class="grid"><div class="resource-item" role="listitem"><div data-title="Loan to {name}" data-date-start="Aug 25, 2024"></div><a href="/news/o{key}"></a><p>A facility closed.</p></div><div class="swiper-slide"><span class="published-date">August 8, 2024</span><h4>Second card of {key}</h4><a href="/research/s{key}"><img src="x"></a></div></div></main><div><a href="/news/lost"></a></div>',
        [
            {"title": "Loan to {name}", "url": "https://base.example/news/o{key}", "item_id": "https://base.example/news/o{key}", "published": "Aug 25, 2024", "body": "A facility closed."},
            {"title": "Second card of {key}", "url": "https://base.example/research/s{key}", "item_id": "https://base.example/research/s{key}", "published": "August 8, 2024", "body": "August 8, 2024 Second card of {key}"},
        ],
    ),
    "card_items": (  # SC10: cards by selectors
        "html",
        '<article data-id="a{key}"><h2><a href="/story/{key}?gclid=t">{name} story</a></h2><form>no <input></form><time datetime="2024-09-01">today</time><p>Closed.</p></article><section class="cards__card card"><h3>Deal of {key}</h3><div><a href="/deal/{key}">A loan.</a></div><div class="card__date">Aug 31, 2024</div></section><a href="/wrapped/{key}"><div class="news-card"><b class="headline">Wrapped {key}</b> 14 Aug 2024</div></a><article><h2><a href="mailto:x@y.example">Contact us</a></h2></article><li class="xCardContent" data-variants="1"><a href="/v/{key}">Variant {key}</a></li><li class="xCardContent">No variant</li>',
        [
            {"title": "{name} story", "url": "https://base.example/story/{key}", "item_id": "a{key}", "published": "2024-09-01", "body": "{name} story today Closed."},
            {"title": "Wrapped {key}", "url": "https://base.example/wrapped/{key}", "item_id": "https://base.example/wrapped/{key}", "published": "14 Aug 2024", "body": "Wrapped {key} 14 Aug 2024"},
            {"title": "Deal of {key}", "url": "https://base.example/deal/{key}", "item_id": "https://base.example/deal/{key}", "published": "Aug 31, 2024", "body": "Deal of {key} A loan. Aug 31, 2024"},
            {"title": "Variant {key}", "url": "https://base.example/v/{key}", "item_id": "https://base.example/v/{key}", "body": "Variant {key}"},
        ],
    ),
    "single_items": (  # SC10, SC11: a page without cards, dated by its linked data
        "html_email",
        '<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"author": {"datePublished": "soon"}}, {"mainEntity": {"datePublished": "2024-05-06T07:08:09Z"}}]}</script></head><body><p>Menu</p><main><h1>Letter {key}</h1><p>Text of {name}, May 1, 2024.</p></main></body></html>',
        [{"title": "Letter {key}", "url": "https://base.example/list", "item_id": "https://base.example/list", "published": "2024-05-06T07:08:09Z", "body": "Letter {key} Text of {name}, May 1, 2024."}],
    ),
    "document_items": (  # SC11, S15
        "document",
        '<html><head><title>t</title><meta property="og:title" content="Page of {name}"><meta name="description" content="D {key}"><link rel="canonical" href="/c/{key}"></head><body><p>Menu</p><article><p>Text of <b>{name}</b></p><script>var x = 1</script><p>on March 5, 2024.</p></article></body></html>',
        [{"title": "Page of {name}", "url": "https://base.example/c/{key}", "item_id": "https://base.example/c/{key}", "published": "March 5, 2024", "body": "Text of {name} on March 5, 2024."}],
    ),
    "dated_items": (  # SC11: metadata before linked data before prose
        "document",
        '<head><meta name="twitter:title" content="Card {key}"><meta name="publish-date" content="2024-04-04"><meta property="og:url" content="/og/{key}"><meta property="og:description" content="Told by {name}"><script type="application/ld+json">{"datePublished": "2023-01-01"}</script></head><body><main></main><h1>Other</h1></body>',
        [{"title": "Card {key}", "url": "https://base.example/og/{key}", "item_id": "https://base.example/og/{key}", "published": "2024-04-04", "body": "Told by {name}"}],
    ),
    "router_items": (  # SC12
        "html",
        '<script>window._ROUTER_DATA = {"x": [1, {"loader": {"article_list": [{"ArticleMeta": {"ArticleID": {key}, "PublishDate": 1706918400000}, "ArticleSubContentEn": {"Title": "{name}", "TitleKey": "r {key}", "Abstract": "<b>New</b> {name}"}}, {"ArticleMeta": {}}]}}]}</script><article><h1>never read</h1></article>',
        [{"title": "{name}", "url": "https://base.example/en/blog/r%20{key}", "item_id": "{key}", "published": "2024-02-03T00:00:00Z", "body": "New {name}"}],
    ),
    "sitemap_items": (  # SC13
        "sitemap_html",
        "<urlset><url><loc>https://base.example/{key}</loc><lastmod>2024-01-01</lastmod></url><sitemap><loc>https://base.example/{key}.xml</loc></sitemap><url></url></urlset>",
        [
            {"title": "https://base.example/{key}", "url": "https://base.example/{key}", "item_id": "https://base.example/{key}", "published": "2024-01-01"},
            {"title": "https://base.example/{key}.xml", "url": "https://base.example/{key}.xml", "item_id": "https://base.example/{key}.xml", "summary": "sitemap"},
        ],
    ),
    "markdown_items": (  # SC14
        "markdown",
        "Before\n## {name} \u2014 2024-03-05\nText [more](/first/{key}?ref=x)\n##### not a heading of its own\n### [Linked](/second) thing\nbody",
        [
            {"title": "{name}", "url": "https://base.example/first/{key}", "item_id": "https://base.example/first/{key}#0", "published": "2024-03-05", "body": "Text [more](/first/{key}?ref=x)\n##### not a heading of its own"},
            {"title": "Linked thing", "url": "https://base.example/second", "item_id": "https://base.example/second#1", "body": "body"},
        ],
    ),
}


def _filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{name}"), F.col("p_name")), F.lit("{key}"), F.col("p_partkey").cast("string"))


def _sql(items: list[dict[str, str]]) -> str:
    items = [x | {"summary": x.get("summary", x.get("body", ""))} for x in items]
    text = lambda x: "replace(replace('" + x.replace("'", "''") + "', '{name}', p_name), '{key}', cast(p_partkey as varchar))"
    rows = (f"select p_partkey, cast({n} as integer) as n, " + ", ".join(f"{text(x.get(c, ''))} as {c}" for c in parsers.FIELDS) + " from part" for n, x in enumerate(items))
    return " union all ".join(rows)


def _register(name: str, lane: str, payload: str, items: list[dict[str, str]]) -> None:
    @query(name, _sql(items))
    def run(spark, d):
        rows = parsers.dealt(table(spark, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").cast("string").alias("source_job_key"), F.col("p_partkey").alias("seq"), F.lit(lane).alias("parser_lane"), F.lit("https://base.example/list").alias("url"), _filled(payload).alias("payload"), F.lit(25).alias("max_items"))
        return parsers.parse(rows, (lane,)).select(F.col("seq").alias("p_partkey"), "n", *(F.coalesce(c, F.lit("")).alias(c) for c in parsers.FIELDS))


for _name, (_lane, _payload, _items) in KINDS.items():
    _register(_name, _lane, _payload, _items)


@query("grounded_leads", "select p_partkey as seq, 'https://h' || p_partkey || '.example/' || case when p_partkey % 2 = 0 then 'b' else 'a' end as grounded_url from part where p_partkey % 2 = 0 or p_partkey % 3 <> 0 order by seq limit 8")
def grounded_leads(spark, d):  # J9, SC19, S11, S25
    """Leads with an even key name a cited page; the others name none, and their host has one or, for multiples of three,
    two pages with other titles."""
    k, host = F.col("p_partkey"), F.concat(F.lit("https://h"), F.col("p_partkey").cast("string"), F.lit(".example/"))
    p = table(spark, d, "part")
    leads = p.select(k.alias("seq"), F.lit("Acme raises debt").alias("headline"), F.concat(host, F.when(k % 2 == 0, "b/").otherwise("x")).alias("source_url"))
    cited = p.select(F.concat(host, F.lit("a")).alias("url"), F.lit("Words of another kind").alias("title"))
    more = p.where((k % 2 == 0) | (k % 3 == 0)).select(F.concat(host, F.lit("b")).alias("url"), F.lit("Nothing alike here").alias("title"))
    return cd.grounded_leads(leads, cited.unionByName(more)).select("seq", "grounded_url")

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.sources import pages as pages_
from tidewell.sources import parsers, urls

FEED = """<rss><channel><item><title>One &nbsp; two</title><link>https://a.example/x?utm_source=y</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description></item><item><title>Three</title><guid>https://a.example/3</guid></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="/p/1"/><updated>2024-03-05T00:00:00Z</updated><summary>s</summary></entry></feed>'
COLUMNS = '{"filings": {"recent": {"accessionNumber": ["1", "2"], "title": ["A", "B"], "url": ["/a", "/b"], "filingDate": ["2024-01-01"]}}}'
LISTING = '<a href="/news/one"><h3>The first headline</h3> March 5, 2024</a><a href="/news/one">Read more</a><a href="/news/two">Second headline here</a><a href="/">Home page of all</a>'
PAGE = '<title>t</title><meta property="og:title" content="Real title"><link rel="canonical" href="/c"><article>Text of March 5, 2024.</article>'
MARKDOWN = "# Changes\n\n## First thing — 2024-03-05\nText [more](/first?ref=x)\n\n## Second thing\nbody\n"
SITEMAP = "<urlset><url><loc>https://a.example/1</loc><lastmod>2024-01-01</lastmod></url><sitemap><loc>https://a.example/map.xml</loc></sitemap></urlset>"


def items(lane, payload, most=25, base="https://a.example/base"):
    out = parsers.parse_payload(lane, payload, base, most)
    assert out["error"] is None, out["error"]
    return out["items"]


def read(spark, lane, *payloads, base="https://a.example/base", most=25):
    rows = spark.createDataFrame([("j", k, lane, base, p, most) for k, p in enumerate(payloads)], "source_job_key string, seq long, parser_lane string, url string, payload string, max_items int")
    return sorted(parsers.parse(rows).collect(), key=lambda r: (r["seq"], r["n"] or 0))


def test_feeds():
    found = items("rss_atom", FEED)
    assert [(x["title"], x["url"], x["body"]) for x in found] == [("One two", "https://a.example/x", "Body"), ("Three", "https://a.example/3", "Three")]
    assert items("rss_atom", ATOM)[0]["url"] == "https://a.example/p/1" and len(items("rss_atom", FEED, 1)) == 1
    bare = "<!DOCTYPE rss SYSTEM 'x'><rss><item><title>No link</title></item><item><guid>g</guid></item><item><title>Cut off</title></item></rss>"
    assert [(x["title"], x["url"], x["item_id"]) for x in items("rss_atom", bare, 2)] == [("No link", "https://a.example/base", "https://a.example/base")]
    bomb = "<!DOCTYPE r [<!ENTITY a 'x'><!ENTITY bb '&a;&a;'>]><rss><item><title>&bb;quiet</title></item></rss>"
    assert items("rss_atom", bomb)[0]["title"] == "quiet"


def test_json():
    assert [(x["title"], x["published"], x["url"]) for x in items("api", COLUMNS)] == [("A", "2024-01-01", "https://a.example/a"), ("B", "", "https://a.example/b")]
    assert items("api", '{"results": [{"headline": "H", "link": "https://b.example/"}, 3]}')[0]["title"] == "H"
    filings = '{"filings": {"recent": {"accessionNumber": ["1"], "form": ["8-K"], "filingDate": ["2024-01-01"]}}}'
    assert [(x["title"], x["url"], x["item_id"]) for x in items("api", filings)] == [("8-K", "https://a.example/base", "1")]
    assert [x["title"] for x in items("api", '[{"title": ""}, {"title": "b"}, {"title": "c"}]', 2)] == ["b"]
    assert [x["title"] for x in items("api", '{"items": {}, "data": {"newsList": [{"name": "in"}]}}')] == []
    assert [x["title"] for x in items("api", '{"title": "the object itself"}')] == ["the object itself"]
    path = '{"data": {"articles": [{"title": "a", "path": "x y", "extra": {"introduction": "i", "date": "2024-01-01"}}]}}'
    assert [(x["url"], x["body"], x["published"]) for x in items("api", path, base="https://qwen.ai/api")] == [("https://qwen.ai/blog?id=x+y", "i", "2024-01-01")]


def test_markdown_and_sitemaps():
    assert [(x["title"], x["url"], x["published"]) for x in items("markdown", MARKDOWN)][1:] == [("First thing", "https://a.example/first", "2024-03-05"), ("Second thing", "https://a.example/base", "")]
    assert [(x["url"], x["summary"]) for x in items("sitemap_html", SITEMAP)] == [("https://a.example/1", ""), ("https://a.example/map.xml", "sitemap")]


@pytest.mark.parametrize(("lane", "payload"), [("rss_atom", "<rss"), ("rss_atom", "<!DOCTYPE x [ <rss/>"), ("api", "{"), ("sitemap_html", "<!ENTITY a 'b'><x/>"), ("fax", "")])
def test_a_bad_payload_is_a_value(lane, payload):
    assert parsers.parse_payload(lane, payload, "https://a.example/", 5)["error"]


def test_cards_of_many_kinds(spark):
    """The best card of a URL stays, where the first stood; dead elements, other hosts and other paths give none; the cap holds."""
    listing, many = LISTING, "".join(f"<article><h2><a href='/p/{k}'>Title number {k}</a></h2></article>" for k in range(9))
    nested = "<article><h2><a href='/outer'>Outer title</a></h2><p>More <div class='caption'><h3>Inner</h3><a href='/inner'>x</a> 2024-01-02</div></article>"
    dead = "<form><article><h2><a href='/news/f'>In a form here</a></h2></article></form><script>var a = '<a href=/news/s>Script has a link</a>'</script>"
    twice = "<article><h2><a href='/news/t'>News</a></h2></article><a href='/news/t'>A title that is longer than its card 2024-05-05</a>"
    alike = "<div class='card'><a href='/news/a'></a><b>too short</b></div><div class='item'><div class='x'><a href='/news/b'>&gt;</a></div>Words enough to be a card</div>"
    rows = read(spark, "html", listing, many, nested, dead, twice, alike, None, "", "plain words only", most=4)
    by = lambda k: [(r["title"], r["url"].partition(".example")[2], r["published"]) for r in rows if r["seq"] == k and r["title"]]
    assert by(0) == [("The first headline", "/news/one", "March 5, 2024"), ("Second headline here", "/news/two", None)]
    assert [t for t, *_ in by(1)] == [f"Title number {k}" for k in range(4)]
    assert by(2) == [("Outer title", "/outer", "2024-01-02"), ("Inner", "/inner", "2024-01-02")]
    assert by(3) == [] and [r["n"] for r in rows if r["seq"] == 3] == [None]
    assert by(4) == [("A title that is longer than its card", "/news/t", "2024-05-05")]
    assert by(5) == [("Words enough to be a card", "/news/b", None)] or by(5) == [("> Words enough to be a card", "/news/b", None)]
    assert by(6) == by(7) == [] and by(8) == [("plain words only", "/base", None)]


def test_random_newsrooms_are_read_back(spark):
    """Pages of cards of every kind, of which the right items are known as they are made."""
    rng = random.Random(4)
    pages, want = [], []
    for page in range(40):
        made, told = [], []
        for k in range(rng.randint(1, 6)):
            title, day, url = f"Title {page} of {k}", f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"/news/{page}-{k}"
            kind = rng.randrange(6)
            made.append(
                (
                    f"<article><h2><a href='{url}'>{title}</a></h2><time datetime='{day}'></time><p>{'x ' * rng.randint(0, 9)}</p></article>",
                    f"<div class='w'><div class='big press-release-box'><h4>{title}</h4><span class='publish'>{day}</span><a href='{url}'>go</a></div></div>",
                    f"<a href='{url}'><div><div class='news-card'><i class='Headline'>{title}</i> {day}</div></div></a>",
                    f"<div role='listitem'><p data-title='{title}' data-date-published='{day}'></p>Words about it all<div><a href='{url}'></a></div></div>",
                    f"<p><a href='{url}'><h3>{title}</h3> {day}</a>",
                    f"<div><a href='{url}?utm_source=q'>{title} {day} Read more at length</a></div>",
                )[kind]
            )
            told.append(((0, k) if kind == 0 else (1, k) if kind == 1 else (2, k) if kind == 2 else (9, k), title, f"https://a.example{url}", day))
        pages.append(f"<html><body><nav><a href='/blog/'>Blog of this site</a></nav><main>{''.join(made)}</main></body></html>")
        want.append([x[1:] for x in sorted(told)])
    rows = read(spark, "html", *pages)
    for page in range(40):
        got = [(r["title"], r["url"], r["published"]) for r in rows if r["seq"] == page]
        assert got == want[page], pages[page]


def test_documents(spark):
    rows = read(spark, "document", PAGE, "<h1>Only a heading</h1>", "<p>no title</p>", "<meta property='og:title' content=''><title>unread</title>", "<title>T</title><main><div class='release-date'>Jul 21, 2024</div><p>On May 1, 2023</p></main>")
    assert [(r["title"], r["url"], r["published"], r["body"]) for r in rows if r["title"]] == [
        ("Real title", "https://a.example/c", "March 5, 2024", "Text of March 5, 2024."),
        ("Only a heading", "https://a.example/base", None, "Only a heading"),
        ("T", "https://a.example/base", "Jul 21, 2024", "Jul 21, 2024 On May 1, 2023"),
    ]
    assert len(rows) == 5


def test_page_trees():
    nodes = pages_.tree("<ul><li>a<li>b<br>c</ul></b><p>x<p>y</article><script>if (a < b) {}</script>tail", "https://a.example/")
    at = {n[5]: n for n in nodes if n[5]}
    inside = lambda text: [n[2] for n in nodes if n[2] and n[0] < at[text][0] <= n[1]]
    assert inside("a") == ["#root", "ul", "li"] and inside("c") == ["#root", "ul", "li"] and inside("y") == ["#root", "p"]
    assert at["if (a < b) {}"][6] and not at["tail"][6] and inside("tail") == ["#root", "p"]
    assert nodes[0][1] == len(nodes) - 1


@pytest.mark.parametrize(
    ("said", "want"),
    [("Aug. 31, 2024", "2024-08-31 00:00:00"), ("31st August 2024", "2024-08-31 00:00:00"), ("Sept 5, 2024 10:15 PM EST", "2024-09-06 03:15:00"), ("Mon, 26 Aug 2024 10:00:00 GMT", "2024-08-26 10:00:00"), ("Tuesday, 27 August 2024 at 1:05 a.m.", "2024-08-27 01:05:00"), ("2024-08-24T19:33:02.123+02:00", "2024-08-24 17:33:02.123"), ("2024-08-24 19:33", "2024-08-24 19:33:00"), ("8/24/2024", "2024-08-24 00:00:00"), ("24/8/2024", "2024-08-24 00:00:00"), ("20240824", "2024-08-24 00:00:00"), ("2024 Aug 24", "2024-08-24 00:00:00"), ("24-Aug-2024", "2024-08-24 00:00:00"), ("12:00 AM", None), ("2024-13-01", None), ("31 Feb 2024", None), ("Augustus 1, 2024", None), ("soon", None), ("", None), (None, None)],
)
def test_dates_as_pages_write_them(spark, said, want):
    got = spark.createDataFrame([(said,)], "c string").select(tx.parse_lenient_time(F.col("c")).cast("string").alias("x")).first()["x"]
    assert got == want


def test_parse_and_walk(spark):
    jobs = spark.createDataFrame([("j1", 1, "rss_atom", "https://a.example/", FEED, 5), ("j2", 2, "api", "https://a.example/", "{", 5)], "source_job_key string, seq long, parser_lane string, url string, payload string, max_items int")
    rows = parsers.parse(jobs).collect()
    assert sorted((r["source_job_key"], r["n"], r["title"]) for r in rows if r["title"]) == [("j1", 0, "One two"), ("j1", 1, "Three")]
    assert [r["error"] is not None for r in rows if r["source_job_key"] == "j2"] == [True]
    inner = "<urlset><url><loc>https://a.example/2</loc></url><sitemap><loc>https://a.example/map.xml</loc></sitemap></urlset>"
    pages = spark.createDataFrame([("https://a.example/root.xml", SITEMAP), ("https://a.example/map.xml", inner)], "url string, body string")
    roots = spark.createDataFrame([("https://a.example/root.xml",)], "url string")
    assert {r["url"] for r in parsers.walk_sitemaps(pages, roots).collect()} == {"https://a.example/1", "https://a.example/2"}


def test_a_walk_fetches_no_more_than_its_budget(spark):
    entry = lambda url, kind="url": f"<{kind}><loc>https://a.example/{url}</loc></{kind}>"
    pages = [("root", entry("m1", "sitemap") + entry("1") + entry("m2", "sitemap") + entry("2") + entry("3")), ("m1", entry("4") + entry("5") + entry("6") + entry("7")), ("m2", entry("8"))]
    pages = spark.createDataFrame([(f"https://a.example/{u}", f"<urlset>{x}</urlset>") for u, x in pages], "url string, body string")
    roots = spark.createDataFrame([("https://a.example/root",)], "url string")
    walked = lambda n: [r["url"].rpartition("/")[2] for r in parsers.walk_sitemaps(pages, roots, n).collect()]
    assert sorted(walked(3)) == ["1"] and sorted(walked(5)) == ["1", "2", "3"] and sorted(walked(7)) == ["1", "2", "3", "4", "5"]


def test_records_newest_first():
    rows = '[{"title": "a", "url": "/a"}, {"title": "b", "url": "/b", "extra": {"date": "2024-01-02"}}, {"title": "c", "url": "/c", "extra": {"published_at": "2024-03-01T00:00:00Z"}}]'
    assert [x["title"] for x in parsers.parse_api(rows, "https://qwen.ai/x", 9)] == ["c", "b", "a"]
    assert [x["title"] for x in parsers.parse_api(rows, "https://a.example/x", 9)] == ["a", "b", "c"]


def test_only_nodes_that_a_selector_picks_leave_the_pass():
    page = "<main><p>one <i>two</i></p><div class='Card'><b>words enough to be</b> <u>a card</u><a href='/news/x'></a></div>" + "<p>three</p>" * 500 + "<form><h2>dead</h2></form></main>"
    nodes, text = pages_.noted(pages_.tree(page, "https://a.example/"))
    assert [n[:3] for n in nodes] == [[0, 3, 0], [1, 3, pages_.MAIN], [2, 3, pages_.BOX], [3, 3, pages_.ANCHOR]]
    assert nodes[3][7] == 2 and text[nodes[2][5] : nodes[2][6]] == "words enough to be a card" and text.startswith("one two words") and "dead" not in text


def test_payloads_of_a_small_file_are_read_by_all_cores(spark):
    from tests.compare import DATA
    from tidewell.plans import registry

    for name in ("dated_items", "feed_items", "sitemap_items"):
        assert registry.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_few_and_many_watch_terms_find_the_same(spark, monkeypatch):
    from tidewell.sources import candidates as cd

    texts = spark.createDataFrame([(1, "The first, word. A third-word here"), (2, "firstword"), (3, None), (4, "word a word")], "k int, t string")
    terms = spark.createDataFrame([("x", "First word"), ("y", "word"), ("z", "a third WORD"), ("s", "a")], "name string, term string")
    found = lambda: cd.watch_hits(texts, terms, F.col("t"), "k").select("k", "hits")
    few = found()
    assert "contains(_p" in few._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {1: ["x", "y", "z"], 2: [], 3: [], 4: ["y"]}
    assert {r["k"]: r["hits"] for r in few.collect()} == want
    monkeypatch.setattr(cd, "LISTED", 0)
    assert {r["k"]: r["hits"] for r in found().collect()} == want


def test_plain_urls_and_instants_need_no_resolving(monkeypatch):
    """What a router's records and most links hold is read by a short way, which gives what the long one gives."""
    from tidewell.sources import urls

    base, hosts = "https://b.example/x", ("", "https://h.example", "http://H.example")
    paths = ("/a", "/a/b/", "/r%20k", "/a//b", "/./a", "/a/..", "/a?b=2&a=1&ref=x", "/a?b", "/a?b=%20", "/a#f", "", "a", "/a;p")
    assert all(urls.canonical(h + p, base) == urls.resolved(h + p, base) for h in hosts for p in paths if p[:1] == "/" or not h)
    assert [urls.canonical_or_none(u, b) for u, b in (("/a", "mailto:x"), ("/a", "https://u:p@h/"), ("", ""), ("https://h/a", "http://[bad"))] == [None] * 4
    want = [pages_.instant(float(at)) for at in (1706918400000, -1, 0)]
    monkeypatch.setattr(urls, "urljoin", None)
    monkeypatch.setattr(pages_.pd, "to_datetime", None)
    assert [pages_.instant(at) for at in (1706918400000, -1, 0)] == want == ["2024-02-03T00:00:00Z", "1969-12-31T23:59:59Z", "1970-01-01T00:00:00Z"]
    monkeypatch.undo()
    assert urls.canonical("/a/b", base) == "https://b.example/a/b"
    monkeypatch.setattr(urls, "urljoin", None)
    assert urls.canonical("/c/d?z=1&a=2", base) == "https://b.example/c/d?a=2&z=1"


ODD = ("<p a=1>x", "<p\xa0a='1'>x", "<p a = '1'>x</p >", "a < b <i>c", "<!-- a -- ><b>c</b><!-- never closed", "<script>a</ script><style>never closed", "<p/><br/>x<p / >y", "<ſ>x<K>", "<x:y-z A='&lt;&amp;' a=''>t & u &lt</x:y-z>", "<![CDATA[x]]><?pi?></>", "<p a\x00b>", "&amp", "")


def test_markup_is_read_as_by_the_library():
    """Plain markup is read by a short way, odd markup by HTMLParser from where it turns odd; both give the nodes that HTMLParser gives for all."""

    def whole(html):
        reader = pages_._Reader("https://a.example/b")
        reader.feed(html)
        return reader.ended()

    rng = random.Random(5)
    pieces = [*ODD, "<!DOCTYPE html>", "<li>", "<td>", "<div class=\"card\" data-title='T'>", "</div>", "<a href='/n?a=1&amp;b=2'>", "</a>", "<form>", "</form>", "<script src='s'/>", "<SCRIPT>if (a < b) {}</SCRIPT>", "text ", "</li>", "<h1>H</h1>"]
    for html in (*ODD, *("".join(rng.choices(pieces, k=rng.randint(2, 20))) for _ in range(2_000))):
        assert pages_.tree(html, "https://a.example/b") == whole(html), html


def test_plain_markup_takes_the_short_way(monkeypatch):
    monkeypatch.setattr(pages_.HTMLParser, "parse_starttag", None)
    monkeypatch.setattr(pages_.HTMLParser, "parse_endtag", None)
    nodes = pages_.tree('<!DOCTYPE html><!-- c --><main id="m"><h1>Letter &amp; 1</h1><script type="application/ld+json">{"datePublished": "2024-05-06"}</script><br/><p>Text</p></main>', "https://a.example/")
    assert [n[2] for n in nodes if n[2]] == ["#root", "main", "h1", "script", "br", "p"] and [n[5] for n in nodes if n[5]][::2] == ["Letter & 1", "Text"]
    assert pages_.told_dates(nodes) == ["2024-05-06"]


def test_elements_that_no_selector_picks_are_not_asked(monkeypatch):
    asked = []
    monkeypatch.setattr(pages_, "CARDS", (lambda tag, attrs, c: asked.append(tag),))
    nodes, text = pages_.noted(pages_.tree("<body><div><p>one <b>two</b></p></div><section class='x'><i>three</i></section><article>four</article></body>", "https://a.example/"))
    assert asked == ["section", "article"] and text == "one two three four" and [n[2] for n in nodes] == [0, pages_.BODY, pages_.ARTICLE]


@pytest.mark.parametrize(("lane", "payload"), [("rss_atom", FEED), ("markdown", MARKDOWN)])
def test_items_leave_the_pass_as_rows(spark, lane, payload):
    """Items are rows of Arrow columns as they leave Python: no pandas, and no arrays to take apart; rows are told apart across batches."""
    rows = spark.range(2_500).select(F.lit("j").alias("source_job_key"), F.col("id").alias("seq"), F.lit(lane).alias("parser_lane"), F.lit("https://a.example/base").alias("url"), F.when(F.col("id") % 3 > 0, payload).alias("payload"), F.lit(25).alias("max_items"))
    made = parsers.parse(rows, (lane,))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    got, each = made.collect(), items(lane, payload)
    assert sorted((r["seq"], r["n"], r["title"], r["error"] is None) for r in got if r["n"] is not None) == [(k, n, x["title"], True) for k in range(2_500) if k % 3 for n, x in enumerate(each)]
    empty = [r for r in got if r["n"] is None]
    assert sorted(r["seq"] for r in empty) == list(range(0, 2_500, 3)) and {r["error"] is None for r in empty} == {lane == "markdown"}


def test_pages_of_the_tables_take_the_short_way(monkeypatch):
    import pyarrow.parquet as pq

    from tests.compare import DATA

    left = []
    monkeypatch.setattr(pages_.HTMLParser, "feed", lambda reader, rest: left.append(len(rest)))
    htmls = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()
    for html in htmls:
        pages_.tree(html or "", "https://a.example/")
    assert sum(left) < 0.05 * sum(len(h or "") for h in htmls), (sum(left), len(htmls))


def test_sections_are_searched_only_for_what_they_may_hold(monkeypatch):
    """Dates are sought only where a year is; the items are those of a search everywhere."""
    sought = []

    class Hint:
        def search(self, text):
            sought.append(text)
            return re.search(tx.DATE_HINT, text)

        def sub(self, by, text):
            sought.append(text)
            return re.sub(tx.DATE_HINT, by, text)

    def everywhere(payload, base, most):
        out = []
        for part in re.split(r"(?m)^(?=#{1,4}\s)", payload):
            if m := re.match(r"#{1,4}\s+(.+)", part):
                link, hint = re.search(r"\[[^\]]*\]\(([^)\s]+)\)", part), re.search(tx.DATE_HINT, part)
                title = re.sub(tx.DATE_HINT, " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", m[1])).strip(" -|:–—")
                url = parsers.canonical(link[1] if link else "", base)
                out.append((" ".join(title.split()), url, f"{url}#{len(out)}", hint[0] if hint else "", part[m.end() :].strip()))
        return out[:most]

    monkeypatch.setattr(parsers, "HINT", Hint())
    pieces = ["# ", "## ", "\n", "\n## ", "\n\n#### ", " ", "two  words", "[l](/a/b?x=1)", "[]()", "[open](", "](", "2024-03-05", "March 5, 2024", "5 Mar 2019", "1899-01-01", "19", "–", "|", "\t", " ", "(x)"]
    pick = random.Random(14)
    for _ in range(3_000):
        payload = "".join(pick.choice(pieces) for _ in range(pick.randrange(14)))
        got = parsers.parse_markdown(payload, "https://a.example/base", 3)
        assert [(x["title"], x["url"], x["item_id"], x["published"], x["body"]) for x in got] == everywhere(payload, "https://a.example/base", 3), payload
    assert sought and all("19" in x or "20" in x for x in sought)


def test_paths_from_the_root_are_resolved_once_a_host(monkeypatch):
    """Paths of any letters go the short way, on whatever page of a host; the URLs are those of resolving each."""
    asked, resolved = [], urls.resolved
    monkeypatch.setattr(urls, "resolved", lambda url, base: asked.append((url, base)) or resolved(url, base))
    urls.origin.cache_clear()
    for k in range(50):
        assert urls.canonical(f"/Cióniedoas,{k}/b", f"https://F16.example/page/{k}?x=[") == f"https://f16.example/Cióniedoas,{k}/b"
    assert len(asked) == 1, asked
    pieces = ["/", "a", "ß", ",", ".", "..", ";", ":", "@", "%41", "?", "&", "=", "#", "[", "\\", " ", "\t", "\n", "\xa0", " ", "\x1f", "\x7f", "\x85", "'", '"', "+", "~", "http://", "https://h.example", "HTTPS://H.example", "//"]
    bases = ["https://A.example/list/x", "http://a.example", "https://a.example:443/x/../y", "https://a.example:8080/", "https://ü.example/p", "https://u@a.example/", "https://a.example#f", "https://a.example\\x", " https://a.example/", "https://a.example./x", "https:///x", "", "x"]
    pick = random.Random(16)

    def outcome(f, url, base):
        try:
            return f(url, base)
        except ValueError:
            return ValueError

    for _ in range(20_000):
        url, base = pick.choice(["", "/", "/"]) + "".join(pick.choice(pieces) for _ in range(pick.randrange(6))), pick.choice(bases)
        assert outcome(urls.canonical, url, base) == outcome(resolved, url, base), (url, base)


def test_printable_text_is_not_searched_for_white_space(monkeypatch):
    searched, blanks = [], pages_.BLANKS

    class Blanks:
        def sub(self, by, text):
            searched.append(text)
            return blanks.sub(by, text)

    monkeypatch.setattr(pages_, "BLANKS", Blanks())
    assert pages_.noted(pages_.tree("<p>One of  two</p><p>three ß four</p><p>five\xa0six</p>", "https://a.example/"))[1] == "One of two three ß four five six"
    assert searched == ["One of  two", "five\xa0six"]
    for c in map(chr, range(0x11000)):
        assert pages_.collapsed(f" a{c}b{c} ") == blanks.sub(" ", f" a{c}b{c} ").strip(" "), hex(ord(c))


def test_texts_without_a_year_are_not_searched_for_dates(spark):
    """The dates are those of a search of all texts."""
    pieces = ["2024-03-05", "March 5, 2024", "5 Mar 2019", "1899-01-01", "19", "20", "2", "0", "99", "-1-1", " ", "  ", "Sept. ", "May 3rd ", "x", "ß", "٢٠", "\n"]
    pick = random.Random(16)
    rows = spark.createDataFrame([(None,), ("",), *(("".join(pick.choice(pieces) for _ in range(pick.randrange(9))),) for _ in range(4_000))], "t string")
    both = rows.select("t", tx.date_hint(F.col("t")).alias("hint"), F.nullif(F.regexp_extract("t", tx.DATE_HINT, 0), F.lit("")).alias("want"))
    got = both.collect()
    assert all(r["hint"] == r["want"] for r in got) and sum(r["hint"] is not None for r in got) > 500
    assert "contains" in rows.select(tx.date_hint(F.col("t")))._jdf.queryExecution().toString().lower()

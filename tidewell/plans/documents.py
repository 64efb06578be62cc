"""Queries over `documents`, `pages`, `labels`, `benchmark` and `conversations`, read as candidates, fetched pages,
decisions, watch terms and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import editorial, evidence, filters, keys, runs, select
from tidewell.plans.registry import query, table
from tidewell.sources import candidates as cd
from tidewell.sources import parsers

HASH = r"""sha256(trim(regexp_replace(source, '\s+', ' ', 'g')) || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)))"""
PAD = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '"
LANE = "case lang when 'en' then 'venture_debt' when 'de' then 'competitor_deposit' else 'ai' end"


def docs(spark, d):
    return table(spark, d, "documents")


def lane():
    return F.when(F.col("lang") == "en", "venture_debt").when(F.col("lang") == "de", "competitor_deposit").otherwise("ai")


@query("content_hash_dedup", f"with h as (select doc_id, source, {HASH} as content_sha256 from documents) select doc_id, content_sha256, sha256(source || '|' || doc_id || '|' || content_sha256) as candidate_id from (select *, row_number() over (partition by content_sha256 order by doc_id) as n from h) where n = 1")
def content_hash_dedup(spark, d):  # S12, S13, W3, ST3 in batch
    h = docs(spark, d).select("doc_id", "source", tx.revision_hash(F.col("source"), F.col("text")).alias("content_sha256"))
    return keys.first(h, ["content_sha256"], "doc_id").select("doc_id", "content_sha256", tx.candidate_key(F.col("source"), F.col("doc_id").cast("string"), F.col("content_sha256")).alias("candidate_id"))


@query("anti_known", "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 0) and sha256(text) not in (select sha256(d.text) from documents d join labels l using (doc_id) where l.toxic = 1)")
def anti_known(spark, d):  # J3
    x = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    labels = table(spark, d, "labels")
    return keys.unknown(x, labels.where("quality = 0").select("doc_id"), x.join(labels.where("toxic = 1").select("doc_id"), "doc_id").select("h"), "doc_id", "h").select("doc_id")


@query(
    "watch_hits",
    f"""
with t as (select distinct item_id, trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:2], ' ')), '[^a-z0-9]+', ' ', 'g')) as t from benchmark),
d as (select doc_id, {PAD} as p from documents),
h as (select doc_id, item_id from d join t on length(t) >= 3 and contains(p, ' ' || t || ' '))
select doc_id, coalesce(array_to_string(list_sort(list(item_id) filter (where item_id is not null))[1:20], ','), '') as hits from documents left join h using (doc_id) group by doc_id""",
)
def watch_hits(spark, d):  # J6, S19
    # The first two words of an item serve as a term, and its number as its name.
    terms = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("term"))
    return cd.watch_hits(docs(spark, d).select("doc_id", "text"), terms, F.col("text"), "doc_id").select("doc_id", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


@query(
    "relevance_cnf",
    f"""
with d as (select doc_id, source, {PAD} as p from documents)
select doc_id, contains(p, ' the of ') or contains(p, ' de la ') as excluded,
  case when source not in ('src0', 'src1', 'src2', 'src3') then true when source = 'src3' then false
    when source = 'src0' then (contains(p, ' the ') or contains(p, ' der ')) and (contains(p, ' que ') or contains(p, ' with '))
    when source = 'src1' then contains(p, ' for ') or contains(p, ' pour ') else false end as relevant from d""",
)
def relevance_cnf(spark, d):  # F5, F6, S19
    rules = spark.createDataFrame([("src0", 1, "the"), ("src0", 1, "der"), ("src0", 2, "que"), ("src0", 2, "with"), ("src1", 1, "for"), ("src1", 1, "pour"), ("src1", 1, "ai"), ("src2", 1, "of")], "source_id string, group_no int, term string")
    strict = spark.createDataFrame([("src0",), ("src1",), ("src2",), ("src3",)], "source_id string")
    x = docs(spark, d).withColumnRenamed("source", "source_id")
    return filters.relevant(x, rules, strict, F.col("text")).select("doc_id", filters.excluded(tx.padded_words(F.col("text")), ["the of", "de la"]).alias("excluded"), "relevant")


@query("keyword_score", r"select doc_id, cast(case when regexp_matches(text, '(?i)\bthe\b') then 3 else 0 end + case when regexp_matches(text, '\d{4}') then 5 else 0 end + case when regexp_matches(text, '\btoken\b') then 8 else 0 end as integer) as score, least(100, 90 + case when lang = 'de' then 15 else 0 end + case when lang = 'fr' then 5 else 0 end) as boosted from documents")
def keyword_score(spark, d):  # A12, S36
    score = select.keyword_score(F.col("text"), {r"(?i)\bthe\b": 3, r"\d{4}": 5, r"\btoken\b": 8})
    return docs(spark, d).select("doc_id", score.alias("score"), tx.boosted(F.lit(90), (F.col("lang") == "de").cast("int"), (F.col("lang") == "fr").cast("int")).alias("boosted"))


@query(
    "eligible_events",
    """
select doc_id, case when quality = 1 then 'A' else 'C' end as tier, quality = 1 or (toxic = 0 and n_chars % 100 >= 80) as admitted
from documents join labels using (doc_id) where quality is not null and n_chars > 0 and not (starts_with(source, 'src1') and lang = 'es')""",
)
def eligible_events(spark, d):  # F9, F11, J7
    quote = F.struct(F.lit("f1").alias("fact_id"), F.lit("c").alias("claim"), F.lit("q").alias("exact_quote"), F.lit("https://a.example/").alias("source_url"))
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "quality", "toxic", "n_chars", F.lit("ELIGIBLE").alias("status"), F.lit("KEEP").alias("decision"), F.lit(False).alias("needs_primary_source"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("2024-01-20").cast("timestamp").alias("observed_at"),
        F.when(F.col("source").startswith("src1") & (F.col("lang") == "es"), "TEST-1").otherwise("RUN-1").alias("run_id"), F.when(F.col("n_chars") > 0, F.array(quote)).alias("facts"), F.array("source").alias("source_ids"), F.lit("https://a.example/").alias("canonical_url"),
    )
    tier = F.when(F.col("quality") == 1, "A").otherwise("C")
    confidence = F.when(F.col("toxic") == 0, F.col("n_chars") % 100).otherwise(0)
    return filters.eligible(x, F.lit("2024-01-17").cast("timestamp")).select("doc_id", tier.alias("tier"), filters.admitted(F.col("decision"), F.col("needs_primary_source"), tier, confidence, F.col("facts"), F.col("source_ids"), F.col("canonical_url")).alias("admitted"))


ORDER_SQL = "len(case when lang = 'de' then ['x'] else [] end) > 0 desc, doc_id % 2 = 0 desc, doc_id % 5, n_chars desc, doc_id"


@query("candidate_order_topk", f"select cast(row_number() over (order by {ORDER_SQL}) as integer) as pos, doc_id from documents order by pos limit 60")
def candidate_order_topk(spark, d):  # T2
    x = docs(spark, d).withColumns({"hits": F.when(F.col("lang") == "de", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "prim": F.col("doc_id") % 2 == 0, "prio": F.element_at(F.array(*map(F.lit, ("P0", "P1", "P2", "P8", "P9"))), (F.col("doc_id") % 5 + 1).cast("int")), "none": F.lit(None).cast("timestamp")})
    x = x.withColumn("prio_no", F.col("doc_id") % 5)
    order = select.candidate_order("hits", "prim", "prio", "n_chars", "none", "doc_id")
    order[2] = F.col("prio_no").asc()
    top = x.orderBy(*order).limit(60)
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "doc_id")  # 60 rows


@query(
    "lane_round_robin",
    f"""
with recursive p as (select doc_id as pos, source as source_id, {LANE} as lane from documents),
q as materialized (select *, row_number() over (partition by lane, source_id order by pos) as depth, min(pos) over (partition by lane, source_id) as f, case lane when 'venture_debt' then 0 when 'competitor_deposit' then 1 else 2 end as l from p),
r as (
  select 0 as n, cast(null as bigint) as pos, cast(null as varchar) as lane, cast(1 as bigint) as depth, 0 as turn, cast([] as bigint[]) as taken, cast([] as varchar[]) as used
  union all
  select * from (
    select n + 1, q.pos, q.lane, q.depth, (l + 1) % 3, list_append(taken, q.pos), list_append(used, source_id) from r join q on q.depth >= r.depth
    where n < 30 and not list_contains(taken, q.pos) and len(list_filter(used, lambda x: x is not distinct from source_id)) < 2
    order by q.depth, case when q.depth = r.depth then (l - turn + 3) % 3 else l end, f limit 1))
select pos as doc_id, lane from r where n > 0 order by n""",
)
def lane_round_robin(spark, d):  # W11
    # The prefix tells a source without a name from an empty name.
    x = docs(spark, d).select(F.col("doc_id").alias("pos"), F.concat(F.lit("="), "source").alias("source_id"), lane().alias("lane"))
    x = x.withColumn("own", F.col("pos").cast("string"))
    return select.balanced(x, [select.Pass(F.lit(True), 30, per_source=2)], F.struct("pos"), "pos", "own", "own", "own").repartition(1).sortWithinPartitions("place").select(F.col("pos").alias("doc_id"), "lane")


@query(
    "source_lane_round_robin",
    f"""
with q as (select doc_id as pos, source, {LANE} as lane from documents), p as (select pos, source || ' ' || lane as source_id, lane from q),
a as (select *, row_number() over (partition by source_id order by pos) as depth, min(pos) over (partition by lane, source_id) as f from p),
b as (select *, min(pos) over (partition by lane, source_id) as g from a where depth <= 2),
c as (select *, row_number() over (partition by lane, depth order by g) as turn, case lane when 'venture_debt' then 0 when 'competitor_deposit' then 1 else 2 end as l from b)
select pos as doc_id, lane from c order by depth, turn, l limit 30""",
)
def source_lane_round_robin(spark, d):  # W11
    x = docs(spark, d).select(F.col("doc_id").alias("pos"), F.concat_ws(" ", "source", lane()).alias("source_id"), lane().alias("lane"))
    x = x.withColumn("own", F.col("pos").cast("string"))
    return select.balanced(x, [select.Pass(F.lit(True), 30, per_source=2)], F.struct("pos"), "pos", "own", "own", "own").select(F.col("pos").alias("doc_id"), "lane")


@query("source_quota", "with w as (select doc_id, source, n_chars % 3 = 0 as wants from documents), r as (select *, sum(case when wants then 1 else 0 end) over (partition by source order by doc_id rows unbounded preceding) as k, row_number() over (partition by source order by doc_id) as n from w) select doc_id, wants and k <= 3 as looked_up, n <= 25 as kept from r")
def source_quota(spark, d):  # W12, T5
    from pyspark.sql import Window

    w = select.budgeted(docs(spark, d), "source", "doc_id", F.col("n_chars") % 3 == 0, 3)
    return w.select("doc_id", "looked_up", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) <= 25).alias("kept"))


@query("item_cap", "select doc_id from (select doc_id, row_number() over (partition by source order by doc_id) as n from documents) where n <= 25")
def item_cap(spark, d):  # T5
    return select.capped(docs(spark, d), "source", "doc_id", 25).select("doc_id")


SECTION = "case source when 'src0' then 'lead' when 'src1' then 'deal_tape' when 'src2' then 'competitive_field' when 'src3' then 'ai_radar' when 'src4' then 'runway_watch' else 'other' end"
SECTION_NO = "case source when 'src0' then 0 when 'src1' then 1 when 'src2' then 2 when 'src3' then 3 when 'src4' then 4 else 5 end"


def section():
    return F.coalesce(F.element_at(tx.mapping({f"src{k}": s for k, s in enumerate(editorial.SECTIONS)}), F.col("source")), F.lit("other"))


@query("running_index", f"select doc_id, {SECTION} as section, row_number() over (partition by {SECTION} order by doc_id) as rank, row_number() over (order by {SECTION_NO}, doc_id) as running from documents")
def running_index(spark, d):  # W7, W8
    x = editorial.ranked_in_section(docs(spark, d).select("doc_id", section().alias("section")), "doc_id")
    return editorial.running_index(x).select("doc_id", "section", F.col("rank").cast("long").alias("rank"), F.col("running").cast("long").alias("running"))


@query("section_counts", f"select array_to_string(list(s || '=' || n order by s), ',') as counts from (select {SECTION} as s, count(*) as n from documents group by 1)")
def section_counts(spark, d):  # A3
    m = runs.section_counts(docs(spark, d).select(section().alias("section")), "section")
    return m.select(F.array_join(F.transform(F.map_entries("section_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("grouped_sections", f"with s(section, section_no) as (values ('lead', 0), ('deal_tape', 1), ('empty_one', 2), ('ai_radar', 3)), d as (select {SECTION} as section, doc_id from documents) select section, section_no, count(doc_id) as n, coalesce(min(doc_id), -1) as first_story from s left join d using (section) group by all")
def grouped_sections(spark, d):  # A20
    s = spark.createDataFrame([("lead", 0), ("deal_tape", 1), ("empty_one", 2), ("ai_radar", 3)], "section string, section_no int")
    x = docs(spark, d).select(section().alias("section"), F.col("doc_id").alias("story_id"))
    return s.join(x, "section", "left").groupBy("section", "section_no").agg(F.count("story_id").alias("n"), F.coalesce(F.min("story_id"), F.lit(-1)).alias("first_story"))


@query("document_counters", "select count(*) as docs, count(distinct lang) as langs, count(distinct source) as sources, count(*) filter (where quality = 1) as good, count(*) filter (where quality is null) as unlabelled from documents left join labels using (doc_id)")
def document_counters(spark, d):  # A1, A2, A21
    x = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return x.agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


URL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query("canary_audit", f"select {URL_HOST} as host, count(url) as items, count(case when page_id % 4 = 0 then 1 end) as dated, count(distinct url) as urls, case when count(url) = 0 then 'EMPTY' when count(case when page_id % 4 = 0 then 1 end) = 0 then 'UNDATED' when count(distinct url) = 1 and (count(url) > 1 or min(url) = 'https://' || {URL_HOST} || '/') then 'COLLAPSED' end as verdict from pages group by 1")
def canary_audit(spark, d):  # A14, F15
    x = table(spark, d, "pages").withColumns({"host": tx.url_host(F.col("url")), "published": F.when(F.col("page_id") % 4 == 0, F.lit("2024-01-01"))}).withColumn("source_url", F.concat(F.lit("https://"), "host", F.lit("/")))
    return filters.canary_verdict(x, "host", "url", "published", "source_url").select("host", "items", "dated", "urls", "verdict")


CANON = r"""
with p as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as a,
  regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') as r from pages),
q as (select *, lower(regexp_replace(regexp_replace(a, ':\d*$', ''), '\.$', '')) as h, regexp_extract(a, ':(\d+)$', 1) as port, regexp_replace(regexp_extract(r, '^([^?]*)', 1), '/{2,}', '/', 'g') as path,
  list_sort(list_transform(list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'), lambda x: x <> '' and lower(string_split(x, '=')[1]) not in ('fbclid','gclid','mc_cid','mc_eid','ref','source','utm_campaign','utm_content','utm_medium','utm_source','utm_term')), lambda x: case when contains(x, '=') then x else x || '=' end)) as qs from p),
c as (select *, case when s <> '' and h <> '' and not contains(a, '@') then s || '://' || h || case when port <> '' and not (s = 'https' and port = '443') then ':' || port else '' end || case when path = '' then '/' else path end || case when len(qs) > 0 then '?' || array_to_string(qs, '&') else '' end end as canonical from q)
"""


@query("canonical_url", CANON + "select page_id, canonical, h as host, regexp_replace(path, '/+$', '') as key_path from c")
def canonical_url(spark, d):  # S10, S11
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.canonical_url(u).alias("canonical"), tx.url_host(u).alias("host"), F.regexp_replace(tx.url_key(u)["path"], "/{2,}", "/").alias("key_path"))


@query("best_per_url", CANON + ", k as (select page_id, h || regexp_replace(path, '/+$', '') as k, length(html) as score from c join pages using (page_id)), f as (select *, min(page_id) over (partition by k) as place, row_number() over (partition by k order by score desc, page_id) as n from k) select page_id, place from f where n = 1 order by place limit 100")
def best_per_url(spark, d):  # W4, S11, T5
    k = tx.url_key(F.col("url"))
    x = table(spark, d, "pages").select("page_id", F.concat(k["host"], F.regexp_replace(k["path"], "/{2,}", "/")).alias("k"), F.length("html").cast("long").alias("score"))
    return keys.best_in_place(x, "k", "score", "page_id", 100).select("page_id", "place")


@query("host_allowlist", r"with p as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as h from pages) select page_id, len(list_filter(['example.com', 'blog.tionsh.example.net'], lambda x: h = x or ends_with(h, '.' || x))) > 0 as allowed, starts_with(lower(url), 'https://') and not contains(regexp_extract(url, '^https://([^/?#]*)', 1), '@') and not regexp_matches(url, '[\x00-\x20\x7f\\]') as safe from p")
def host_allowlist(spark, d):  # F16, F17
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", filters.host_allowed(tx.url_host(u), F.array(F.lit("example.com"), F.lit("blog.tionsh.example.net"))).alias("allowed"), filters.safe_url(u).alias("safe"))


@query("page_domains", r"select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') as domain, 'WEB-' || upper(substr(sha256(url), 1, 16)) as web_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') as slug from pages")
def page_domains(spark, d):  # S40, S14, S28, S27
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.normalize_domain(u).alias("domain"), tx.short_id(u).alias("web_id"), tx.slug(u).alias("slug"))


@query("html_title_text", r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, coalesce(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') as lang, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as n_text from pages")
def html_title_text(spark, d):  # SC11, S15 as expressions
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"\s+", " ")).cast("long").alias("n_text"))


@query("parse_pages")
def parse_pages(spark, d):  # SC10, SC11, SC15, SC16
    jobs = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_job_key"), F.col("page_id").alias("seq"), F.when(F.col("page_id") % 2 == 0, "html").otherwise("document").alias("parser_lane"), "url", F.col("html").alias("payload"), F.lit(25).alias("max_items"))
    return parsers.parse(jobs, ("html", "document"))


@query("money_extract", None)
def money_extract(spark, d):  # S21
    return docs(spark, d).select("doc_id", F.array_join(F.transform(tx.amounts(F.col("text")), lambda a: F.concat_ws(" ", a["currency"], tx.plain_decimal(a["amount"]))), ",").alias("amounts"))


@query("number_subset", None)
def number_subset(spark, d):  # S22, S23, U5
    allowed = table(spark, d, "benchmark").select(F.explode(tx.numbers(F.col("text"))).alias("x")).distinct().withColumn("known", F.lit(1))
    x = docs(spark, d).select("doc_id", tx.numbers(F.col("text")).alias("n"))
    found = x.select("doc_id", F.explode_outer("n").alias("x")).join(allowed, "x", "left")
    return found.groupBy("doc_id").agg(F.count("x").alias("numbers"), (F.count("x") == F.count("known")).alias("subset"))


@query(
    "token_overlap_join",
    f"""
with b as (select item_id, list_distinct(list_filter(string_split(trim({PAD}), ' '), lambda x: length(x) > 2 and x not in ('and','for','from','the','with'))) as t from benchmark),
p as (select x.item_id as a, y.item_id as b, len(list_intersect(x.t, y.t)) / greatest(1, least(len(x.t), len(y.t))) as s from b x join b y on x.item_id <> y.item_id)
select a, b, round(s, 6) as overlap from p where s >= 0.2""",
)
def token_overlap_join(spark, d):  # S25
    """Pairs of items that overlap; only items with a word in common are compared."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), tx.token_set(F.col("text")).alias("t")).withColumn("w", F.explode("t"))
    other = b.select(F.col("a").alias("b"), F.col("t").alias("u"), "w")
    met = b.join(other, "w").where("a <> b").dropDuplicates(["a", "b"])
    return met.select("a", "b", F.round(tx.token_overlap(F.col("t"), F.col("u")), 6).alias("overlap")).where("overlap >= 0.2")


@query(
    "quote_grounding",
    r"""
with q as (select item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}_$€£%]+', ' ', 'g')) || ' ' as t from benchmark),
d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}_$€£%]+', ' ', 'g')) || ' ' as t from documents)
select doc_id, item_id from d join q on contains(d.t, q.t)""",
)
def quote_grounding(spark, d):  # F23 in part, S20
    q = table(spark, d, "benchmark").select("item_id", tx.grounded(F.col("text")).alias("q"))
    return evidence.quoted(docs(spark, d).select("doc_id", tx.grounded(F.col("text")).alias("t")), q, "doc_id", "t", "item_id", "q")


@query("columnar_transpose", "select vec_id, i - 1 as row_no, round(embedding[i], 6) as x, label_list[i] as y from (select vec_id, embedding, [label, vec_id] as label_list, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def columnar_transpose(spark, d):  # SC9, U6
    e = table(spark, d, "embeddings")
    return parsers.transpose(e.select("vec_id", "embedding", "label"), {"x": F.col("embedding"), "y": F.array(F.col("label").cast("long"), F.col("vec_id"))}).select("vec_id", F.col("row_no").cast("long").alias("row_no"), F.round("x", 6).alias("x"), "y")


@query("conversation_messages", "select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles, sum(length(text)) as chars, arg_max(role, turn) as last_role from conversations group by conv_id")
def conversation_messages(spark, d):  # ordered collect, W6
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"), F.sum(F.length("text")).alias("chars"), F.max_by("role", "turn").alias("last_role"))


@query("word_count", r"select item_id, len(regexp_extract_all(text, '[A-Za-z0-9_''-]+')) as words from benchmark")
def word_count(spark, d):  # A16, on ASCII texts
    return table(spark, d, "benchmark").select("item_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_'-]+"), F.lit(0))).cast("long").alias("words"))


@query("prompt_guards", r"select doc_id, case when regexp_matches(text, '(?i)(?:ignore\s+(?:all|any|the|your)?\s*(?:previous|prior|above)\s+instructions|system\s+prompt|developer\s+message|call\s+(?:a\s+)?tool|do\s+not\s+follow\s+your\s+instructions)') then 1 else 0 end as warnings, contains(lower(text), 'example.com') or contains(lower(text), 'token') as leaks, substr(text, 1, 280) as excerpt from documents")
def prompt_guards(spark, d):  # F19, F20, F22, S32
    t = F.col("text")
    x = docs(spark, d).withColumns({"warnings": F.size(filters.warnings(t)), "leaks": filters.leaks(t, ["example.com", "TOKEN"]), "excerpt": t})
    return filters.packet(x, {"excerpt": 280}, ["doc_id", "warnings", "leaks"])


@query("repeated_texts", "select sha256(text) as key, count(*) as n from documents group by 1 having count(*) > 1")
def repeated_texts(spark, d):  # A17
    return runs.repeated(docs(spark, d), F.sha2("text", 256))


@query("seed_headlines", f"with t as (select doc_id, n_chars, lang = 'en' as disc, trim({PAD}) as k from documents), o as (select *, row_number() over (partition by k order by disc desc, n_chars desc, doc_id desc) as n from t) select doc_id from o where n = 1 order by disc desc, n_chars desc, doc_id desc limit 20")
def seed_headlines(spark, d):  # T3
    x = docs(spark, d).withColumn("disc", F.col("lang") == "en").withColumn("none", F.lit(None).cast("timestamp"))
    return select.seeds(x, "disc", "n_chars", "none", "doc_id", "text", 20).select("doc_id")


@query("labels_once", "with w as (select doc_id, unnest(string_split(text, ' ')) as label, unnest(range(len(string_split(text, ' ')))) as pos from documents), k as (select *, row_number() over (partition by doc_id, lower(label) order by pos) as m from w where trim(lower(label)) <> '' and label is not null) select doc_id, row_number() over (partition by doc_id order by pos) as n, label from k where m = 1")
def labels_once(spark, d):  # W13, S27
    x = docs(spark, d).select("doc_id", F.split("text", " ").alias("w"))
    return keys.labels_once(x, "doc_id", ["w"], lambda c: F.lower(c)).select("doc_id", F.col("n").cast("long").alias("n"), "label").where(F.trim("label") != "")


@query("evidence_codes")
def evidence_codes(spark, d):  # F23, J11, F26, X1, S20, S21
    x = docs(spark, d).select("doc_id", "text", "lang", "source", F.col("doc_id").cast("string").alias("candidate_id"))
    quote = F.array_join(F.slice(F.split(tx.grounded(F.col("text")), " "), 3, 6), " ")
    fact = F.struct(F.lit("f1").alias("fact_id"), F.lit("claim").alias("claim"), F.when(F.col("doc_id") % 5 == 0, "words that no source has").otherwise(quote).alias("exact_quote"), F.lit("https://a.example/x").alias("source_url"))
    analysis = x.select("candidate_id", F.when(F.col("doc_id") % 7 == 0, "DROP").otherwise("KEEP").alias("decision"), F.when(F.col("doc_id") % 11 == 0, "none").otherwise("ai_radar").alias("section"), F.lit("launch").alias("event_type"), F.array(fact).cast(evidence.FACTS).alias("facts"), F.array().cast(evidence.AMOUNTS).alias("amounts"), F.array(F.split("text", " ")[0]).alias("entities"))
    joined = evidence.annotated(x.drop("doc_id").withColumn("doc_id", F.col("candidate_id").cast("long")), analysis).withColumns({"expected_id": F.col("candidate_id"), "approved_urls": F.array(F.lit("https://a.example/x")), "discovery_only": F.col("doc_id") % 13 == 0, "primary_source": F.col("doc_id") % 2 == 0, "source_class": F.lit("B"), "confidence": F.lit(80), "borrower": F.lit(""), "lenders": F.array().cast("array<string>"), "rate": F.lit(""), "maturity": F.lit(""), "event_date": F.lit(""), "published_at": F.lit(None).cast("timestamp")})
    return joined.select("doc_id", F.array_join(evidence.evidence_codes(F.col("text")), ",").alias("codes"))

"""Queries that check drafted stories and editions, made of the rows of `part` ten a draft, and the numbers of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import editorial
from tidewell.plans.registry import query, table
from tidewell.sources import sinks

#: Codes of the story of part k: each of eleven kinds has its own fault, or none.
CODES = """
with s as (
  select p_partkey as k, p_partkey // 10 as d, case p_partkey % 11
    when 0 then 'HEADLINE_FORMAT_INVALID' when 1 then 'MODEL_COPY_CONTAINS_URL_OR_EMAIL' when 2 then 'UNSUPPORTED_FACT_ID' when 3 then 'NUMBER_NOT_IN_SELECTED_FACTS'
    when 4 then 'SOURCE_CITATION_MISSING' when 5 then 'DECLARED_ENTITY_NOT_IN_COPY,UNSUPPORTED_ENTITY' when 6 then 'BANNED_OR_SLOPPY_COPY'
    when 7 then case when p_partkey % 2 = 0 then 'POSSIBLE_INVENTED_ENTITY,POSSIBLE_INVENTED_ENTITY_TOKEN_ZETA' else '' end when 8 then case when p_partkey % 2 = 0 then 'UNKNOWN_EVENT_ID' else '' end
    when 9 then case when p_partkey % 10 >= 2 and p_partkey > 2 then 'DUPLICATE_EVENT' else 'UNKNOWN_EVENT_ID' end else 'SECTION_MISMATCH' end as codes
  from part where p_partkey % 3 <> 0
  union all select p_partkey, p_partkey // 10, '' from part where p_partkey % 3 = 0)
"""


def _drafted(spark, d):
    """Stories and their events. Of three parts one has a story without a fault."""
    k = F.col("p_partkey")
    kind, name = F.when(k % 3 == 0, 99).otherwise(k % 11), F.concat(F.lit("Co"), k.cast("string"))
    event = lambda n: F.concat(F.lit("e"), n.cast("string"))
    even = k % 2 == 0
    dek = F.when(kind == 1, "see www.x.example now").when(kind == 3, "it grew 15%").when(kind == 6, "it is a paradigm shift").when((kind == 7) & even, "it met Zeta").otherwise("it grew 12%")
    none = F.array().cast("array<string>")
    stories = table(spark, d, "part").select(
        F.floor(k / 10).alias("draft_id"), k.alias("seq"), F.when(kind == 10, "deal_tape").otherwise("ai_radar").alias("section"),
        F.when((kind == 8) & even, "none").when(kind == 9, event(k - 2)).otherwise(event(k)).alias("event_id"),
        F.concat(name, F.when(kind == 0, ": ").otherwise(editorial.SEPARATOR), F.lit("grows")).alias("headline"), F.when(kind == 2, "it grew").otherwise(dek).alias("dek"), F.lit("so it does").alias("why_it_matters"),
        F.when(kind == 2, none).otherwise(F.array(F.lit("f"))).alias("fact_ids"), F.array(F.when(kind == 4, "t").otherwise("s")).alias("source_ids"), F.when(kind == 5, F.array(name, F.lit("Nix"))).otherwise(F.array(name)).alias("entities"),
    )
    fact = F.struct(F.lit("f").alias("fact_id"), F.lit("it grew 12%").alias("claim"), F.lit("").alias("exact_quote"))
    events = table(spark, d, "part").select(F.floor(k / 10).alias("draft_id"), event(k).alias("event_id"), F.lit("ai_radar").alias("section"), F.array(name).alias("entities"), F.array(F.lit("f")).alias("fact_ids"), F.array(F.lit("s"), F.lit("t")).alias("source_ids"), F.array(F.lit("s")).alias("sources"), F.array(fact).alias("facts"))
    return stories, events


@query("story_checks", CODES + "select k as p_partkey, codes from s")
def story_checks(spark, d):  # F24, S24, J8
    return editorial.judged(*_drafted(spark, d)).select(F.col("seq").alias("p_partkey"), F.array_join("codes", ",").alias("codes"))


@query(
    "edition_checks",
    CODES
    + """,
b as (select d, count(*) as n, count(*) filter (where codes = '') as stories, min(k) filter (where codes = '') as first_k, list_sort(list_distinct(flatten(list(case when codes = '' then [] else string_split(codes, ',') end)))) as story_codes,
  coalesce(bool_or(k = 10 * d + 4 and codes <> ''), false) as fourth_out from s group by d),
c as (
  select *, d % 5 = 1 and fourth_out as replaced, d % 7 = 0 as quiet, d % 2 = 0 as repaired, len(story_codes) > 0 as flawed from b),
e as (
  select *, list_filter([case when not quiet and stories = 0 then 'NON_QUIET_DAY_HAS_NO_STORIES' end, case when quiet then 'QUIET_DAY_HAS_STORIES' end, case when n >= 8 and stories < 8 and not (repaired and flawed) then 'STORY_FLOOR_NOT_MET' end], lambda x: x is not null) as codes from c)
select d as draft_id, array_to_string(codes, ',') as codes, array_to_string(story_codes, ',') as story_codes, len(codes) = 0 and not (flawed and (not repaired or stories = 0)) as accepted,
  case when replaced then case when stories > 0 then 'Co' || first_k || ' — grows' else 'Venture Debt + AI Daily' end else 'News' end as headline, stories from e
""",
)
def edition_checks(spark, d):  # F24, F31
    stories, events = _drafted(spark, d)
    i = F.col("draft_id")
    drafts = stories.select("draft_id").distinct().select("draft_id", (i % 7 == 0).alias("quiet"), (i % 2 == 0).alias("repaired"), F.lit("Daily").alias("kicker"), F.lit("News").alias("headline"), F.when(i % 5 == 1, F.concat(F.lit("With Co"), (i * 10 + 4).cast("string"))).otherwise("of the day").alias("deck"))
    out = editorial.edition_codes(drafts, editorial.judged(stories, events), events)
    return out.select("draft_id", F.array_join("codes", ",").alias("codes"), F.array_join("story_codes", ",").alias("story_codes"), "accepted", "headline", "stories")


#: Numbers by pieces: a mark before each digit that no word character stands before takes the place of a look behind.
NUMBERS = r"""
with t as (select doc_id, regexp_replace(' ' || coalesce(text, ''), '([^A-Za-z0-9_])([0-9])', '\1' || chr(1) || '\2', 'g') as t from documents),
p as (select doc_id, regexp_extract_all(t, pat, 1) as n, regexp_extract_all(t, pat, 2) as u, regexp_extract_all(t, pat, 3) as s
  from t, (select '(?i)' || chr(1) || '([0-9][0-9,' || chr(1) || ']*(?:\.' || chr(1) || '?[0-9]+)?)\s*(trillion|billion|million|thousand|tn|bn|mm|b|m|k)?\s*(%|percent|per\s+cent)?' as pat)),
x as (select doc_id, replace(replace(unnest(n), chr(1), ''), ',', '') as n, lower(unnest(u)) as u, unnest(s) as s from p),
e as (select doc_id, split_part(n, '.', 1) as w, split_part(n, '.', 2) as f, s, case when u in ('k', 'thousand') then 3 when u in ('m', 'mm', 'million') then 6 when u in ('b', 'bn', 'billion') then 9 when u in ('tn', 'trillion') then 12 else 0 end as e from x),
v as (select doc_id, ltrim(w || case when e > 0 then rpad(substr(f, 1, e), e, '0') else '' end, '0') as w, rtrim(substr(f, e + 1), '0') as f, s from e),
d as (select distinct doc_id, case when w = '' then '0' else w end || case when f = '' then '' else '.' || f end || case when coalesce(s, '') = '' then '' else '%' end as x from v)
select documents.doc_id, coalesce(string_agg(x, ' ' order by x), '') as numbers from documents left join d on documents.doc_id = d.doc_id group by documents.doc_id
"""


@query("text_numbers", NUMBERS)
def text_numbers(spark, d):  # S22, S23
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.numbers(F.coalesce("text", F.lit(""))), " ").alias("numbers"))


MONEY = r"""
with l as (select p_partkey as k, p_name || ' pays ' || s || cast(p_size as varchar) || ',000.5' || u || ' or ' || p_size || ' ' || c || ' now' as t, s, u, c, cast(p_size as bigint) as p_size from part, (values ('$', ' million', 'GBP'), ('US$', 'k', 'usd'), (chr(163), '', 'EUR')) as v(s, u, c) where (p_partkey % 3 = 0) = (s = '$') and (p_partkey % 3 = 1) = (s = 'US$'))
select k as p_partkey, case when s = chr(163) then 'GBP' else 'USD' end || ' ' || cast(case u when ' million' then p_size * 1000000000 + 500000 when 'k' then p_size * 1000000 + 500 else p_size * 1000 end as varchar) || case when u = '' then '.5' else '' end as first_amount, upper(c) || ' ' || p_size as second_amount from l
"""


@query("money_amounts", MONEY)
def money_amounts(spark, d):  # S21, S37
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % 3 + 1).cast("int"))
    text = F.concat("p_name", F.lit(" pays "), pick("$", "US$", "£"), size, F.lit(",000.5"), pick(" million", "k", ""), F.lit(" or "), size, F.lit(" "), pick("GBP", "usd", "EUR"), F.lit(" now"))
    found = F.transform(F.reverse(F.array_sort(tx.amounts(text))), lambda a: F.concat_ws(" ", a["currency"], tx.plain_decimal(a["amount"])))
    return table(spark, d, "part").select("p_partkey", found[0].alias("first_amount"), found[1].alias("second_amount"))


#: Ten parts an edition, of which those in the last two of each seven editions are no stories.
RENDERED = r"""
with s as (
  select p_partkey // 10 as run_id, case p_partkey % 4 when 0 then 2 when 1 then 0 when 2 then 4 else 0 end as no, p_partkey as k, p_name as headline, 'About ' || p_brand as dek, p_type as why,
    case when p_partkey % 3 = 0 then 'Sources: Source: https://a.example/' || p_partkey || ' | ' || p_brand || ': https://b.example' end as sources from part where (p_partkey // 10) % 7 < 5),
t as (select *, row_number() over (partition by run_id order by no, k) as n, '\n' || headline || '\n' || dek || '\n\nANALYST COMMENTARY\n' || why || coalesce('\n' || sources, '') as told from s),
g as (select run_id, no, case no when 0 then 'TOP STORY' when 2 then 'BANKS + DEPOSITS' else 'VENTURE CAPITAL' end || '\n' || string_agg(told, '\n' order by k) as part_text from t group by run_id, no),
b as (select run_id, string_agg(part_text, '\n\n' order by no) as body from g group by run_id),
l as (select run_id, count(*) as n, string_agg(n || '. ' || headline, '\n' order by n) as glance from t group by run_id),
e as (select distinct p_partkey // 10 as run_id from part)
select e.run_id, case when e.run_id % 2 = 0 then '[TEST] ' else '' end || 'Edition ' || e.run_id as subject,
  case when e.run_id % 2 = 0 then 'TEST RENDER · EMAIL DELIVERY DISABLED\n\n' else '' end || 'Edition ' || e.run_id || '\n' || case when e.run_id % 3 = 0 then 'A deck\n' else '' end || '2024-01-25' || '\n\n'
    || coalesce(n, 0) || case when n = 1 then ' STORY' else ' STORIES' end || '\n' || coalesce(glance, 'No stories today.') || '\n\n' || coalesce(body, 'No material stories today.') as text
from e left join l on e.run_id = l.run_id left join b on e.run_id = b.run_id
""".replace("'\\n", "chr(10) || '").replace("\\n", "' || chr(10) || '")


@query("rendered_editions", RENDERED)
def rendered_editions(spark, d):  # SK9, SK10
    k, p = F.col("p_partkey"), table(spark, d, "part")
    run = F.floor(k / 10)
    cited = lambda name, url: F.struct(F.lit(name).alias("publisher") if isinstance(name, str) else name.alias("publisher"), url.alias("url"))
    links = F.when(k % 3 == 0, F.array(cited(" ", F.concat(F.lit("https://a.example/"), k.cast("string"))), cited("plain", F.lit("http://c.example/")), cited("user", F.lit("https://u@c.example/")), cited(F.col("p_brand"), F.lit("https://b.example"))))
    section = F.element_at(F.array(*map(F.lit, ("competitive_field", "lead", "runway_watch", "unknown"))), (k % 4 + 1).cast("int"))
    stories = p.where(run % 7 < 5).select(run.alias("run_id"), section.alias("section"), k.alias("rank"), F.col("p_name").alias("headline"), F.concat(F.lit("About "), "p_brand").alias("dek"), F.col("p_type").alias("why_it_matters"), links.alias("citations"))
    editions = p.select(run.alias("run_id")).distinct().select("run_id", F.concat(F.lit("Edition "), F.col("run_id").cast("string")).alias("headline"), F.when(F.col("run_id") % 3 == 0, "A deck").otherwise(" ").alias("deck"), F.lit("2024-01-25").alias("edition_date"), (F.col("run_id") % 2 == 0).alias("test"))
    return sinks.rendered_editions(editions, stories).drop("html")

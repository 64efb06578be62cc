"""Queries over the relational tables, read as registries, settings, recipients and stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import editorial, evidence, filters, jobs, keys, rank, runs
from tidewell.plans.registry import query, table
from tidewell.sources import sinks, tables

WORDS = ["true", "No", " YES ", "0", "active", "disabled", "maybe", ""]
CADENCES = ["15 minutes", "every 6 hours", "daily", "weekly", "2.5 hours", "7", "1 month", "3 hrs", "", "every 90 min", "0.5 days", "2 weeks"]
LISTS = ["a, b;c|a", '["x","y","x"]', " ", "One;two ,One", "[broken", "solo"]
TIERS = ["A", "d", "3-primary", "2-discovery", "Official blog", "social feed", "B", "regulatory"]


def cycle(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def sql_cycle(values, n):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{n} % {len(values)} + 1]"


W = f"lower(trim({sql_cycle(WORDS, 'p_partkey')}))"


@query("bool_parse", f"select p_partkey, case when {W} = '' then false when {W} in ('true','1','yes','y','active','enabled','approved') then true when {W} in ('false','0','no','n','inactive','disabled','blocked') then false end as v from part")
def bool_parse(spark, d):  # S2
    return table(spark, d, "part").select("p_partkey", tx.parse_bool(cycle(WORDS, F.col("p_partkey")), False).alias("v"))


C = f"case when lower(trim({sql_cycle(CADENCES, 'p_partkey')})) = '' then 'daily' else lower(trim({sql_cycle(CADENCES, 'p_partkey')})) end"


@query(
    "cadence_parse",
    rf"""with c as (select p_partkey, {C} as t from part), n as (select *, coalesce(try_cast(nullif(regexp_extract(t, '\d+(?:\.\d+)?', 0), '') as double), 1.0) as k from c)
select p_partkey, greatest(15, cast(round_even(k * case when regexp_full_match(t, '\d+(?:\.\d+)?') or contains(t, 'min') then 1 when contains(t, 'hour') or regexp_matches(t, '\bhr') then 60 when contains(t, 'week') then 10080 when contains(t, 'month') then 43200 else 1440 end, 0) as integer)) as minutes from n""",
)
def cadence_parse(spark, d):  # S7
    return table(spark, d, "part").select("p_partkey", tx.cadence_minutes(cycle(CADENCES, F.col("p_partkey"))).alias("minutes"))


@query("list_parse", f"select p_partkey, case p_partkey % 6 when 0 then 'a,b,c' when 1 then 'x,y' when 2 then '' when 3 then 'One,two' when 4 then '[broken' else 'solo' end as items from part")
def list_parse(spark, d):  # S6
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.parse_list(cycle(LISTS, F.col("p_partkey"))), ",").alias("items"))


@query("normalized_keys", "select p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') as k, case p_partkey % 8 when 1 then 'D' when 3 then 'C' when 4 then 'B' when 5 then 'D' when 6 then case when p_size > 25 then 'A' else 'B' end else 'A' end as tier, coalesce(nullif(trim(upper(p_brand)), ''), 'none') as brand from part")
def normalized_keys(spark, d):  # S1, S8, S9
    primary = (F.col("p_partkey") % 8 == 6) & (F.col("p_size") > 25)
    return table(spark, d, "part").select("p_partkey", tx.normalize_key(F.col("p_name")).alias("k"), tx.source_tier(cycle(TIERS, F.col("p_partkey")), primary).alias("tier"), tx.first_filled(F.lit(" "), F.upper("p_brand"), F.lit("none")).alias("brand"))


SECTIONS, LANES = ["The Lead", "deals", "AI", "Deposit-Watch", "runway", "nothing"], ["RSS", "json api", "Web Page", "sitemap", "md", "email", "fax"]


@query("aliases", "select n_nationkey, case n_nationkey % 6 when 0 then 'lead' when 1 then 'deal_tape' when 2 then 'ai_radar' when 3 then 'deposit_watch' when 4 then 'runway_watch' end as section, case n_nationkey % 7 when 0 then 'rss_atom' when 1 then 'api' when 2 then 'html' when 3 then 'sitemap_html' when 4 then 'markdown' when 5 then 'html_email' end as lane, case n_nationkey % 6 when 2 then 'ai' when 3 then 'competitor_deposit' else 'venture_debt' end as op_lane from nation")
def aliases(spark, d):  # S8, S30, SC15
    n = F.col("n_nationkey")
    section = tx.section_of(cycle(SECTIONS, n))
    return table(spark, d, "nation").select("n_nationkey", section.alias("section"), tx.parser_lane(cycle(LANES, n)).alias("lane"), F.coalesce(tx.operating_lane(section), F.lit("venture_debt")).alias("op_lane"))


@query("reason_codes", "select p_partkey, coalesce(nullif(substr(trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 80), ''), 'UNKNOWN') as code, right('0000000000' || p_partkey, 10) as padded, upper(substr(string_split(p_type, ' ')[1], 1, 1) || coalesce(substr(string_split(p_type, ' ')[2], 1, 1), '')) as initials, try_cast(p_size as integer) as size from part")
def reason_codes(spark, d):  # S26, S31, S28, S43
    return table(spark, d, "part").select("p_partkey", tx.reason_code(F.col("p_type")).alias("code"), tx.padded_number(F.concat(F.lit("#"), F.col("p_partkey").cast("string"))).alias("padded"), tx.initials(F.col("p_type")).alias("initials"), tx.optional_int(F.col("p_size").cast("string")).alias("size"))


@query(
    "expand_jobs",
    """
with s as (select s_suppkey, s_suppkey % 7 <> 0 as active, 'https://x.example/' || s_suppkey || case when s_suppkey % 3 = 0 then '/{cik}' else '' end || case when s_suppkey % 5 = 0 then '/{number}' else '' end || case when s_suppkey % 11 = 0 then '/{void}' else '' end as url from supplier),
c as (select right('0000000000' || n_nationkey, 10) as v from nation), r as (select 'R' || r_regionkey as v from region),
a as (select s.*, c.v as cv from s left join c on contains(url, '{cik}')), b as (select a.*, r.v as rv from a left join r on contains(url, '{number}'))
select s_suppkey || coalesce(':' || cv, '') || coalesce(':' || rv, '') as source_job_key, replace(replace(url, '{cik}', coalesce(cv, '')), '{number}', coalesce(rv, '')) as resolved_url, case when contains(url, '{void}') then 'MISSING_VOID' else '' end as errors from b where active""",
)
def expand_jobs(spark, d):  # F1, J5, S31, S44
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    part = lambda k, text: F.when(key % k == 0, text).otherwise("")
    src = s.select(key.cast("string").alias("source_id"), (key % 7 != 0).alias("active"), F.concat(F.lit("https://x.example/"), key.cast("string"), part(3, "/{cik}"), part(5, "/{number}"), part(11, "/{void}")).alias("url"))
    cik = table(spark, d, "nation").select(tx.padded_number(F.col("n_nationkey").cast("string")).alias("value"))
    number = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("value"))
    out = jobs.expand(src, {"cik": ((r"\{cik\}",), cik), "number": ((r"\{number\}",), number), "void": ((r"\{void\}",), cik.limit(0))})
    return out.select("source_job_key", "resolved_url", F.array_join("configuration_errors", ",").alias("errors"))


@query("source_scan", "select s_suppkey as source_id, case when s_suppkey % 2 = 0 then 'lead' else 'ai_radar' end as section, 'rss_atom' as parser_lane, 60 * (1 + s_suppkey % 5) as cadence_minutes, 'example.com,b.example' as domains, 25 as max_items from supplier where s_suppkey % 4 <> 1")
def source_scan(spark, d):  # SC1, SC2
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(k.cast("string").alias("Source ID"), F.when(k % 2 == 0, "the lead").otherwise("AI").alias("Section"), F.col("s_name").alias("Source Name"), F.lit("https://example.com/feed").alias("URL"), F.lit(" feed ").alias("Method"), F.concat((1 + k % 5).cast("string"), F.lit(" hours")).alias("Cadence"), F.lit("B").alias("Source Tier"), F.when(k % 4 == 1, "no").otherwise("").alias("Active"), F.lit("Example.com; b.example;example.com").alias("Allowed Domains"))
    return tables.sources(tables.scan(raw)).select(F.col("source_id").cast("long").alias("source_id"), "section", "parser_lane", "cadence_minutes", F.array_join("allowed_domains", ",").alias("domains"), "max_items")


@query("settings_scan", "select 'send_hour_' || r_regionkey as setting, cast(r_regionkey as varchar) as text_value, case when r_regionkey = 2 then true when r_regionkey = 3 then null end as flag from region")
def settings_scan(spark, d):  # SC3
    k = F.col("r_regionkey")
    rows = table(spark, d, "region").select(F.concat(F.lit(" Send Hour "), k.cast("string")).alias("setting"), k.cast("string").alias("value"))
    return tables.settings(rows).select("setting", "text_value", F.when(F.col("text_value") == "2", tx.parse_bool(F.lit("yes"))).alias("flag"))


@query("watchlist_scan", "select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment else c_name end as name from customer where c_custkey % 5 <> 0")
def watchlist_scan(spark, d):  # SC4, S9
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(k.cast("string").alias("id"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("company"), F.col("c_mktsegment").alias("name"), F.when(k % 5 == 0, "FALSE").when(k % 5 == 1, "yes").alias("active"))
    return tables.watchlist(raw, {"id": ["id"], "name": ["company", "name"], "active": ["active"]}).select(F.col("id").cast("long").alias("c_custkey"), "name")


@query(
    "recipient_classes",
    """
with e as (select c_custkey, case when c_custkey % 4 = 0 then 'bad address' else ' User' || (c_custkey % 90) || '@Example.com ' end as email, c_custkey % 6 <> 0 as on_ from customer),
c as (select *, lower(trim(email)) as m, case when not on_ then 'INACTIVE' when lower(trim(email)) = 'user7@example.com' then 'EXCLUDED' when c_custkey % 4 = 0 then 'INVALID' end as k from e),
x as (select *, row_number() over (partition by k, m order by c_custkey) as n from c), y as (select *, case when k is null and n > 1 then 'DUPLICATE' else k end as k2 from x),
z as (select *, row_number() over (partition by k2 order by c_custkey) as p from y)
select case when k2 is not null then k2 when p > 49 then 'OVER_CAP' else 'ACCEPTED' end as class, count(*) as n from z group by 1""",
)
def recipient_classes(spark, d):  # SC5, A15, S38, W3
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(k.alias("seq"), F.when(k % 4 == 0, "bad address").otherwise(F.concat(F.lit(" User"), (k % 90).cast("string"), F.lit("@Example.com "))).alias("email"), F.when(k % 6 == 0, "no").otherwise("yes").alias("active"))
    return tables.recipients(raw, ["USER7@example.com"], 49, "seq").groupBy("class").agg(F.count("*").alias("n"))


@query("merge_upsert", "select c_custkey, c_name, c_acctbal, cast(null as varchar) as c_mktsegment from customer where c_custkey % 4 = 0 union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 4 <> 0 and c_custkey % 3 = 0")
def merge_upsert(spark, d):  # SK1, SK3
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return keys.merge(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 4 = 0").drop("c_mktsegment").withColumn("extra", F.lit(1)), ["c_custkey"])


@query("append_absent", "with t as (select c_custkey from customer where c_custkey % 2 = 0), m as (select coalesce(max(c_custkey), 0) as top from t) select 'R' || case when length(cast(top + row_number() over (order by c_custkey) as varchar)) < 3 then lpad(cast(top + row_number() over (order by c_custkey) as varchar), 3, '0') else cast(top + row_number() over (order by c_custkey) as varchar) end as recipient_id, c_name from customer, m where c_custkey % 2 = 1")
def append_absent(spark, d):  # SK12, A19
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    target = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("recipient_id"), "c_name")
    return keys.append_absent(target, c, "c_name", "recipient_id", "R", "c_custkey").select("recipient_id", "c_name")


@query("compare_and_set", "select s_suppkey, s_name, case when s_suppkey % 2 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier")
def compare_and_set(spark, d):  # SK11
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_acctbal").alias("expected_s_acctbal"), (F.col("s_acctbal") + 1).alias("new_s_acctbal"))
    return keys.compare_and_set(s, changes, "s_suppkey", ["s_acctbal"])


@query("cell_values", "select o_orderkey, case when o_orderstatus = 'O' then 'TRUE' else 'FALSE' end as open, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as at, case when o_orderkey % 3 = 0 then '''=' || o_orderpriority else o_orderpriority end as note, '[\"' || o_orderstatus || '\"]' as list, '{\"a\":\"' || o_orderpriority || '\",\"b\":' || o_custkey || '}' as held from orders")
def cell_values(spark, d):  # SK6, S42
    o = table(spark, d, "orders")
    out = o.select("o_orderkey", (F.col("o_orderstatus") == "O").alias("open"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("="), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("note"), F.array("o_orderstatus").alias("list"), F.struct(F.col("o_custkey").alias("b"), F.col("o_orderpriority").alias("a")).alias("held"))
    cells = sinks.cells(out)
    return cells.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("argmax_edition", "select o_orderkey, o_orderdate from orders order by case when o_orderstatus = 'F' then null else o_orderdate end desc nulls last, o_orderkey desc limit 1")
def argmax_edition(spark, d):  # W5
    o = table(spark, d, "orders").withColumn("at", F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")))
    return keys.newest(o, "at", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("last_ready_edition", "select o_custkey, max(o_orderkey) as o_orderkey from orders where o_orderstatus = 'O' group by o_custkey")
def last_ready_edition(spark, d):  # W6
    return keys.last_read(table(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("one_fingerprint", "select o_custkey, min(c_name) as payload from orders join customer on o_custkey = c_custkey group by o_custkey")
def one_fingerprint(spark, d):  # A11, J2
    o = table(spark, d, "orders").select("o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("payload")), "o_custkey")
    return runs.one_fingerprint(o, "o_custkey", "payload").select("o_custkey", "payload")


@query("item_counts", "with a as (select o_custkey, count(*) as items from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey, count(*) as items from orders where o_orderstatus = 'O' group by 1) select * from b union all select * from a where o_custkey not in (select o_custkey from b)")
def item_counts(spark, d):  # A13, U1
    o = table(spark, d, "orders")
    return runs.item_counts(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("existing_keys", "select distinct c_custkey, 'known' as k from customer where c_custkey in (select o_custkey from orders) union all select c_custkey, 'missing' from customer where c_custkey not in (select o_custkey from orders)")
def existing_keys(spark, d):  # A9, A22, J13, J14, U3
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return runs.exists(c, o, "c_custkey").withColumn("k", F.lit("known")).unionByName(jobs.missing_ids(c, o, "c_custkey").withColumn("k", F.lit("missing")))


@query("default_row", "select 'quiet' as kind, cast(0 as bigint) as n union all select 'busy', count(*) from nation group by n_regionkey having n_regionkey = 1")
def default_row(spark, d):  # F29
    n = table(spark, d, "nation")
    empty = runs.or_default(n.where("n_nationkey < 0").select(F.lit("none").alias("kind"), F.lit(0).cast("long").alias("n")), spark.range(1).select(F.lit("quiet").alias("kind"), F.lit(0).cast("long").alias("n")))
    full = runs.or_default(n.where("n_regionkey = 1").groupBy("n_regionkey").agg(F.count("*").alias("n")).select(F.lit("busy").alias("kind"), "n"), spark.range(1).select(F.lit("quiet").alias("kind"), F.lit(0).cast("long").alias("n")))
    return empty.unionByName(full)


@query("published_history", "select o_orderkey, coalesce(case when o_custkey % 2 = 0 then o_orderdate end, case when o_custkey % 3 = 0 then o_orderdate + interval 1 day end, o_orderdate - interval 1 day) as history_at from orders where o_orderstatus in ('O', 'P') and coalesce(case when o_custkey % 2 = 0 then o_orderdate end, case when o_custkey % 3 = 0 then o_orderdate + interval 1 day end, o_orderdate - interval 1 day) >= timestamp '1997-01-01'")
def published_history(spark, d):  # F10, T4
    o, at = table(spark, d, "orders"), F.col("o_orderdate").cast("timestamp")
    s = o.withColumns({"status": F.when(F.col("o_orderstatus") == "O", "SENT").when(F.col("o_orderstatus") == "P", "PUBLISHED").otherwise("HELD"), "included_at": F.when(F.col("o_custkey") % 2 == 0, at), "selected_at": F.when(F.col("o_custkey") % 3 == 0, at + F.expr("INTERVAL 1 DAY")), "published_at": at - F.expr("INTERVAL 1 DAY"), "digest_date": F.lit(None).cast("date")})
    return filters.published_history(s, F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", F.col("history_at").cast("timestamp_ntz").alias("history_at"))


@query("public_addresses", "with a as (select p_partkey, p_partkey % 256 as x, (p_partkey // 7) % 256 as y from part) select p_partkey, not (x = 0 or x = 10 or (x = 100 and y between 64 and 127) or x = 127 or (x = 169 and y = 254) or (x = 172 and y between 16 and 31) or (x = 192 and y = 168) or (x = 192 and y = 0 and p_partkey % 9 in (0, 2)) or (x = 198 and y between 18 and 19) or (x = 198 and y = 51 and p_partkey % 9 = 100) or x >= 224) as public from a")
def public_addresses(spark, d):  # F18
    k = F.col("p_partkey")
    address = F.concat_ws(".", (k % 256).cast("string"), (F.floor(k / 7) % 256).cast("string"), (k % 9).cast("string"), F.lit("1"))
    return table(spark, d, "part").select("p_partkey", filters.public_ipv4(address).alias("public"))


@query("contract_codes", "select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_discount > 1 then 'CONFIDENCE_OUT_OF_RANGE' end, case when l_linenumber = 1 then 'KEEP_WITHOUT_FACTS' end, case when l_returnflag = 'R' and l_linestatus = 'F' then 'PRIMARY_AND_DISCOVERY' end, case when l_quantity * 3 > 100 then 'SCORE_OUT_OF_RANGE' end, case when l_returnflag = 'A' then 'URL_NOT_HTTPS' end], lambda x: x is not null), ',') as codes from lineitem")
def contract_codes(spark, d):  # F27
    x = table(spark, d, "lineitem").withColumns({"primary_source": F.col("l_returnflag") == "R", "discovery_only": F.col("l_linestatus") == "F", "decision": F.lit("KEEP"), "facts": F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("f"))), "source_ids": F.array(F.lit("s")), "confidence": F.when(F.col("l_discount") > 1, 101).otherwise(50), "editorial_score": F.col("l_quantity") * 3, "url": F.when(F.col("l_returnflag") == "A", "http://x.example").otherwise("https://x.example")})
    return x.select("l_orderkey", "l_linenumber", F.array_join(evidence.contract_codes(), ",").alias("codes"))


@query("amount_labels", "select o_orderkey, case when o_custkey % 3 = 0 then 'USD' else 'EUR' end || ' ' || regexp_replace(regexp_replace(cast(cast(o_totalprice as decimal(38,6)) as varchar), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') as label from orders")
def amount_labels(spark, d):  # S23, S37
    price = F.col("o_totalprice").cast("decimal(38,6)")
    return table(spark, d, "orders").select("o_orderkey", tx.amount_label(F.when(F.col("o_custkey") % 3 == 0, "USD").otherwise("EUR"), F.when(F.col("o_custkey") % 2 == 0, price), price).alias("label"))


@query("edition_stories", "with s as (select o_orderkey, o_custkey, ['lead','deal_tape','competitive_field','ai_radar','runway_watch'][o_orderkey % 5 + 1] as section from orders) select o_orderkey as story_id, s.section, row_number() over (partition by s.section order by o_orderkey) as rank, c_name as company, 2 as words, 1 as citations from s join customer on s.o_custkey = c_custkey")
def edition_stories(spark, d):  # F31, J7, J8, J10, W7, A16, S37
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.col("o_custkey").alias("event_id"), F.element_at(F.array(*map(F.lit, editorial.SECTIONS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("section"), F.col("o_orderkey").alias("seq"), F.lit("Headline").alias("headline"), F.lit("dek").alias("dek"), F.array(F.col("o_custkey").cast("string")).alias("fact_ids"))
    c = table(spark, d, "customer")
    events = c.select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("company"), F.lit("USD").alias("currency"), F.lit(1).cast("decimal(38,6)").alias("total_commitment"), F.lit(None).cast("decimal(38,6)").alias("initial_funding"))
    facts = c.select(F.col("c_custkey").cast("string").alias("fact_id"), F.col("c_nationkey").cast("string").alias("source_id"), F.lit("https://a.example").alias("source_url"))
    return editorial.edition(o, events, facts).select("story_id", "section", F.col("rank").cast("long").alias("rank"), "company", "words", F.size("citations").alias("citations"))


@query("outbox", "select o_orderkey, case when o_custkey % 2 = 0 then 'HELD_TEST_MODE' when o_custkey % 3 = 0 then 'HELD_NO_RECIPIENTS' else 'READY_TO_SEND' end as status from orders where o_orderkey % 5 <> 0")
def outbox(spark, d):  # SK8, ST9
    o = table(spark, d, "orders")
    sends = o.select(F.col("o_orderkey").alias("send_id"), (F.col("o_custkey") % 2 == 0).alias("test_mode"), F.lit(True).alias("send_enabled"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(5).alias("recipients"))
    return sinks.outbox(o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("send_id")), sends).select(F.col("send_id").alias("o_orderkey"), "status")


@query("logo_domains", "select s_suppkey, coalesce(nullif(trim(case when s_suppkey % 5 = 0 then 'own.example' else ' ' end), ''), case when n_regionkey < 3 then lower(n_name) || '.example' end, lower(r_name) || '.example') as logo from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def logo_domains(spark, d):  # J12
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", editorial.logo_domain(F.when(F.col("s_suppkey") % 5 == 0, "own.example").otherwise(" "), F.when(F.col("n_regionkey") < 3, F.concat(F.lower("n_name"), F.lit(".example"))), F.concat(F.lower("r_name"), F.lit(".example"))).alias("logo"))


@query("date_hints", "with t as (select p_partkey, ['on 2024-03-05 we', 'March 5, 2024 news', 'the 5th March 2024', 'no date', '2024/3/5'][p_partkey % 5 + 1] as t from part) select p_partkey, case p_partkey % 5 when 0 then '2024-03-05' when 1 then 'March 5, 2024' when 2 then '5th March 2024' when 4 then '2024/3/5' end as hint, case when p_partkey % 5 <> 3 then timestamp '2024-03-05 00:00:00' end as at from t")
def date_hints(spark, d):  # S17, S18, S5
    t = cycle(["on 2024-03-05 we", "March 5, 2024 news", "the 5th March 2024", "no date", "2024/3/5"], F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", tx.date_hint(t).alias("hint"), tx.parse_lenient_time(tx.date_hint(t)).cast("timestamp_ntz").alias("at"))


@query("cell_times", "select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate when 1 then o_orderdate - interval 2 hour when 2 then date_trunc('day', o_orderdate) end as at, case when o_orderkey % 4 < 2 then true else false end as aware from orders")
def cell_times(spark, d):  # S3, S4, S41
    at = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", tx.parse_cell_time(text).cast("timestamp_ntz").alias("at"), tx.parse_aware_time(text).isNotNull().alias("aware"))


@query("ranked_orders", "select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by floor(o_totalprice / 1000) desc, o_orderdate desc, o_orderkey desc) as n from orders) where n = 1 order by floor(o_totalprice / 1000) desc, o_orderdate desc, o_orderkey desc limit 30")
def ranked_orders(spark, d):  # T1, W2
    o = table(spark, d, "orders").withColumns({"score": F.floor(F.col("o_totalprice") / 1000), "less": -F.col("o_orderkey")})
    best = keys.best(o, ["o_custkey"], [F.desc("score"), F.desc("o_orderdate")], "less")
    return best.orderBy(F.desc("score"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select("o_orderkey", "o_custkey")


@query("stored_events", "select o_orderkey, case when o_orderstatus = 'O' then 'KEEP' else 'DROP' end as decision, case when o_orderkey % 2 = 0 then 'announced' else 'unknown' end as event_status, cast(o_custkey % 100 as integer) as confidence, 0 as editorial_score, 1 as facts from orders where o_orderkey % 3 <> 0")
def stored_events(spark, d):  # F28, SK2, S33, S43
    k = F.col("o_orderkey")
    notes = F.to_json(F.struct(F.array(F.struct(F.lit("f1").alias("fact_id"), F.lit("c").alias("claim"))).alias("verified_facts")))
    raw = table(spark, d, "orders").select(F.when(k % 3 != 0, k.cast("string")).otherwise(" ").alias("event_id"), F.lit("c").alias("candidate_id"), F.when(F.col("o_orderstatus") == "O", "accept").otherwise("drop").alias("agent_decision"), F.when(k % 2 == 0, "Announced").otherwise("??").alias("event_status"), (F.col("o_custkey") % 100).cast("string").alias("confidence"), F.lit("").alias("editorial_score"), F.lit("").alias("published_at"), F.lit('["s"]').alias("source_ids"), F.lit("https://a.example").alias("canonical_url"), notes.alias("notes"))
    return evidence.events_of_rows(raw).select(F.col("event_id").cast("long").alias("o_orderkey"), "decision", "event_status", "confidence", "editorial_score", F.size("facts").alias("facts"))


@query("recency_scores", "select o_orderkey, round(greatest(0.0, 10 - least(10.0, greatest(0.0, (epoch_us(timestamp '1998-08-01') - epoch_us(o_orderdate)) / 3.6e9) / 7.2)), 6) as recency from orders")
def recency_scores(spark, d):  # T8
    return table(spark, d, "orders").select("o_orderkey", F.round(rank.recency(F.lit("1998-08-01").cast("timestamp"), F.col("o_orderdate")), 6).alias("recency"))


@query("emails", "select c_custkey, case when c_custkey % 3 = 0 then null else 'user.' || c_custkey || '@example.com' end as email, 'https://s.example/?q=' || replace(url_encode('(' || c_mktsegment || ') when:7d'), '%20', '+') as search from customer")
def emails(spark, d):  # S38, S39
    k = F.col("c_custkey").cast("string")
    mail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user@"), k)).otherwise(F.concat(F.lit("  User."), k, F.lit("@Example.COM")))
    return table(spark, d, "customer").select("c_custkey", tx.normalize_email(mail).alias("email"), tx.search_url(F.lit("https://s.example/?q="), F.col("c_mktsegment"), "7d").alias("search"))


@query("rendered_digest")
def rendered_digest(spark, d):  # SK9, W8
    x = table(spark, d, "nation").select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("headline"))
    ranked = editorial.running_index(editorial.ranked_in_section(x, "seq"))
    return sinks.rendered(ranked.withColumn("section_no", F.col("section")).withColumn("url", F.lit("https://a.example/")), markup=True)

"""Queries over `events`, read as receipts and scored events: user is the job, ts the version, value the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import filters, health, jobs, keys, rank, runs
from tidewell.plans.registry import query, table

AS_OF = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
SQL_AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"


@query(
    "rank_unpublished_events",
    f"""
with e as (select event_id, ts, value, user_id || '|' || props as h, event_type from events),
p as (select distinct h from e where event_type = 'signup' and ts >= {SQL_AS_OF} - interval 15 day and ts < {SQL_AS_OF} - interval 8 day),
s as (select event_id, h, cast(floor(value / 10) as bigint) as score,
  round(greatest(0.0, 10 - least(10.0, greatest(0.0, (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 3.6e9) / 7.2)), 6) as recency
  from e where ts >= {SQL_AS_OF} - interval 8 day and ts <= {SQL_AS_OF} + interval 1 hour and h not in (select h from p)),
b as (select *, row_number() over (partition by h order by score desc, recency desc, event_id desc) as n from s)
select cast(row_number() over (order by score desc, recency desc, event_id desc) as bigint) as pos, event_id, score, recency
from b where n = 1 order by pos limit 60""",
)
def rank_unpublished_events(spark, d):  # J4, W2, T1, T8, F10
    as_of = F.expr(AS_OF)
    e = table(spark, d, "events").select("event_id", "ts", "value", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "props").alias("h"))
    history = e.where((F.col("event_type") == "signup") & (F.col("ts") >= F.expr(f"{AS_OF} - INTERVAL 15 DAYS")) & (F.col("ts") < F.expr(f"{AS_OF} - INTERVAL 8 DAYS"))).select("h").distinct()
    fresh = e.where((F.col("ts") >= F.expr(f"{AS_OF} - INTERVAL 8 DAYS")) & (F.col("ts") <= F.expr(f"{AS_OF} + INTERVAL 1 HOUR"))).join(history, "h", "left_anti")
    scored = fresh.select("event_id", "h", F.floor(F.col("value") / 10).alias("score"), F.round(rank.recency(as_of, F.col("ts")), 6).alias("recency"))
    top = rank.rank(scored, "h", "score", "recency", "event_id", 60)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("recency")).alias("b"), (-F.col("event_id")).alias("c"), "event_id", "score", "recency")))
    return top.agg(ordered.alias("x")).select(F.posexplode("x").alias("n", "x")).select((F.col("n") + 1).cast("long").alias("pos"), "x.event_id", "x.score", "x.recency")  # 60 rows


@query("latest_receipt_per_job", "select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n = 1")
def latest_receipt_per_job(spark, d):  # W1
    return keys.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


@query(
    "due_jobs",
    f"""
with l as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n = 1),
j as (select c_custkey, 60 * (1 + c_custkey % 48) as minutes, l.ts, case when l.event_type = 'error' then l.ts + interval 24 hour end as q from customer left join l on c_custkey = l.user_id)
select c_custkey as source_job_key, cast(minutes as bigint) as cadence_minutes, ts is null or ((q is null or q <= {SQL_AS_OF}) and (epoch_us({SQL_AS_OF}) - epoch_us(ts)) / 60e6 >= minutes) as due,
 q is null or q <= {SQL_AS_OF} as sweep from j""",
)
def due_jobs(spark, d):  # J1, F2, F3, W1
    last = keys.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("source_job_key"), "ts", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("q"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("source_job_key"), (60 * (1 + F.col("c_custkey") % 48)).cast("long").alias("cadence_minutes"))
    as_of = F.expr(AS_OF)
    return jobs.with_latest(own, last).select("source_job_key", "cadence_minutes", jobs.due(as_of, F.col("ts"), F.col("q"), F.col("cadence_minutes")).alias("due"), jobs.not_quarantined(as_of, F.col("q")).alias("sweep"))


@query(
    "failure_streak_quarantine",
    """
with e as (select *, event_type <> 'error' as ok, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as isl from events),
s as (select *, cast(sum(case when ok then 0 else 1 end) over (partition by user_id, isl order by ts, event_id rows unbounded preceding) as integer) as f,
  last_value(case when ok then ts end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as l from e)
select user_id, event_id, f as consecutive_failures, case when f >= 2 then 'QUARANTINED' when ok then 'SUCCESS' else 'FAILED' end as status,
  case when f >= 2 then ts + interval 24 hour end as quarantined_until, l as last_success_at from s""",
)
def failure_streak_quarantine(spark, d):  # W9, W10
    e = table(spark, d, "events")
    out = health.streaks(e, "user_id", ["ts", "event_id"], F.col("event_type") != "error", "ts", threshold=2)
    return out.select("user_id", "event_id", "consecutive_failures", "status", "quarantined_until", "last_success_at")


@query(
    "health_gate",
    f"""
with l as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n = 1),
j as (select c_custkey, c_custkey % 3 = 0 as due, case c_nationkey % 3 when 0 then 'venture_debt' when 1 then 'competitor_deposit' else 'ai' end as lane,
  coalesce(l.event_type <> 'error' and epoch_us({SQL_AS_OF}) - epoch_us(ts) between 0 and 129600000000, false) as ok from customer left join l on c_custkey = user_id),
t as (select count(*) filter (where due) as n, count(*) filter (where due and ok) as k, coalesce(bool_or(ok and lane = 'venture_debt'), false) as a, coalesce(bool_or(ok and lane = 'competitor_deposit'), false) as b, coalesce(bool_or(ok and lane = 'ai'), false) as c from j),
r as (select n, k, k / n as ratio, list_filter([case when a then 'venture_debt' end, case when b then 'competitor_deposit' end, case when c then 'ai' end], lambda x: x is not null) as cov,
 list_filter([case when not a then 'venture_debt' end, case when not b then 'competitor_deposit' end, case when not c then 'ai' end], lambda x: x is not null) as mis from t),
q as (select *, list_filter([case when ratio < 0.8 then 'CORE_COVERAGE_BELOW_THRESHOLD' end, case when len(mis) > 0 then 'CORE_LANE_SOURCE_MISSING' end], lambda x: x is not null) as codes from r)
select n as expected_jobs, k as healthy_jobs, round(ratio, 6) as healthy_ratio, array_to_string(cov, ',') as covered_lanes, array_to_string(mis, ',') as missing_lanes, array_to_string(codes, ',') as reason_codes, len(codes) = 0 as healthy from q""",
)
def health_gate(spark, d):  # A4, A5, A6, S30, J1
    section = F.when(F.col("c_nationkey") % 3 == 0, "deal_tape").when(F.col("c_nationkey") % 3 == 1, "deposit_watch").otherwise("ai_radar")
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("source_job_key"), (F.col("c_custkey") % 3 == 0).alias("due"), tx.operating_lane(section).alias("lane"), F.lit("1").alias("parser_version"))
    last = keys.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("source_job_key"), F.col("ts").alias("checked_at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("health_status"), F.lit("1").alias("receipt_version"))
    out = health.gate(health.job_health(own, last, F.expr(AS_OF)), 0.8, F.lit(True))
    return out.select("expected_jobs", "healthy_jobs", F.round("healthy_ratio", 6).alias("healthy_ratio"), *(F.array_join(c, ",").alias(c) for c in ("covered_lanes", "missing_lanes", "reason_codes")), "healthy")


@query(
    "freshness_window",
    f"""
with c as (select user_id, count(*) as n from events group by user_id),
b as (select greatest({SQL_AS_OF} - interval 8 day, coalesce(max(ts) filter (where event_type = 'purchase' and ts < {SQL_AS_OF} - interval 2 day), {SQL_AS_OF} - interval 96 hour)) as cutoff from events),
o as (select event_id, coalesce(case when event_type <> 'view' then ts end, case when n = 1 then ts end) as seen, cutoff from events join c using (user_id), b)
select event_id, seen, coalesce(seen >= cutoff and seen <= {SQL_AS_OF} + interval 1 hour, false) as fresh from o""",
)
def freshness_window(spark, d):  # F7, F8, A13, ST4, ST6
    e = table(spark, d, "events")
    as_of = F.expr(AS_OF)
    counts = e.groupBy("user_id").agg(F.count("*").alias("items"))
    sent = e.where((F.col("event_type") == "purchase") & (F.col("ts") < F.expr(f"{AS_OF} - INTERVAL 2 DAYS"))).agg(F.max("ts").alias("last_sent"))
    bound = sent.select(filters.window_start(as_of, F.col("last_sent"), F.lit(False)).alias("cutoff"))
    joined = e.join(counts, "user_id").crossJoin(F.broadcast(bound))  # one row
    seen = filters.observed(F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp")), F.lit(""), F.col("ts").cast("timestamp"), F.col("items")).cast("timestamp_ntz")
    return joined.withColumn("seen", seen).select("event_id", "seen", filters.fresh(F.col("seen"), F.lit(""), F.col("cutoff"), as_of).alias("fresh"))


@query(
    "local_hour_guard",
    """
with l as (select event_id, timezone('America/New_York', timezone('UTC', ts)) as t from events)
select event_id, hour(t) = 10 as in_hour, isodow(t) in (1, 3, 5) and hour(t) = 10 and minute(t) < 30 as in_window from l""",
)
def local_hour_guard(spark, d):  # F12, F13
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", filters.inside_hour(ts, "America/New_York", 10).alias("in_hour"), filters.inside_send_window(ts, "America/New_York", 10, 30).alias("in_window"))


@query("json_props", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.missing'), '') as missing, json_valid(props) as valid from events")
def json_props(spark, d):  # SC8, S33, SC15
    held = F.from_json("props", "struct<k:bigint,missing:string>")
    return table(spark, d, "events").select("event_id", held["k"].alias("k"), F.coalesce(held["missing"], F.lit("")).alias("missing"), held.isNotNull().alias("valid"))


@query(
    "health_scan",
    """select event_id, 'RUN-' || event_type as run_id, cast(floor(value) as integer) as item_count, ts as checked_at from events where starts_with('RUN-' || event_type, 'RUN-p') or starts_with('RUN-' || event_type, 'RUN-s')""",
)
def health_scan(spark, d):  # SC6, F21
    from tidewell.sources import tables

    raw = table(spark, d, "events").select(F.col("event_id").cast("string").alias("source_job_key"), F.lit("").alias("source_id"), F.concat(F.lit("RUN-"), "event_type").alias("run_id"), F.lit("").alias("status"), F.lit("").alias("parser_version"), F.lit("").alias("failure_stage"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("checked_at"), F.lit("").alias("updated_at"), F.floor("value").cast("string").alias("item_count"), F.lit("").alias("consecutive_failures"), F.lit("[]").alias("reason_codes"))
    return tables.health(raw, ["RUN-p", "RUN-s"]).select(F.col("source_job_key").cast("long").alias("event_id"), "run_id", "item_count", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"))


@query(
    "outcome_receipts",
    """select event_id, case when event_type = 'error' then 'FAILED' when event_type = 'purchase' then 'SUCCESS' else 'VALID_EMPTY' end as health_status,
 case when event_type = 'error' then cast(user_id % 4 as integer) + 1 else 0 end as consecutive_failures,
 case when event_type = 'error' then 'UPSTREAM_ERROR' when event_type = 'view' then 'NEEDS_PRIMARY_SOURCE' when event_type = 'purchase' then '' else 'EVIDENCE_DROP' end as reason_codes,
 case when event_type not in ('error', 'purchase') then '{"content_hash":"' || sha256(props) || '","evidence_policy_version":"v2"}' end as notes from events""",
)
def outcome_receipts(spark, d):  # F25, S26
    decision = F.when(F.col("event_type") == "purchase", "KEEP").when(F.col("event_type") == "view", "NEEDS_PRIMARY_SOURCE").otherwise("DROP")
    o = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source_job_key"), F.col("event_id").alias("candidate_id"), decision.alias("decision"), F.when(F.col("event_type") == "error", "upstream: error!").alias("error_type"), (F.col("user_id") % 4).cast("int").alias("previous_failures"), F.sha2("props", 256).alias("content_hash"))
    return health.receipts(o, "v2").select(F.col("candidate_id").alias("event_id"), "health_status", "consecutive_failures", F.array_join("reason_codes", ",").alias("reason_codes"), "notes")


@query("last_sent", "select max(coalesce(case when value > 50 then ts end, ts - interval 1 day)) as last_sent_at, max(ts) as last_checked_at from events where event_type = 'purchase'")
def last_sent(spark, d):  # A7, A8
    e = table(spark, d, "events").withColumns({"status": F.when(F.col("event_type") == "purchase", "SENT").otherwise("OTHER"), "accepted_at": F.when(F.col("value") > 50, F.col("ts")), "completed_at": F.col("ts") - F.expr("INTERVAL 1 DAY")})
    return runs.last_sent(e, ["accepted_at", "completed_at"]).crossJoin(e.where("status = 'SENT'").agg(F.max("ts").alias("last_checked_at")))  # one row each


@query(
    "delivery_gate",
    """select event_id, case when event_type = 'error' then 'HELD_SOURCE_HEALTH' when user_id % 10 = 0 then 'HELD_TEST_MODE' when value < 5 then 'HELD_NO_MATERIAL_STORIES' when user_id % 7 = 0 then 'HELD_NO_RECIPIENTS' end as held,
 case when event_type = 'error' or coalesce(user_id % 10 = 0, true) then true else false end as test_mode from events""",
)
def delivery_gate(spark, d):  # F14, F30
    u = F.col("user_id")
    held = filters.held_reason([(F.col("event_type") == "error", "HELD_SOURCE_HEALTH"), (u % 10 == 0, "HELD_TEST_MODE"), (F.col("value") < 5, "HELD_NO_MATERIAL_STORIES"), (u % 7 == 0, "HELD_NO_RECIPIENTS")])
    return table(spark, d, "events").select("event_id", held.alias("held"), filters.effective_test(u % 10 == 0, F.col("event_type") == "error").alias("test_mode"))


@query(
    "delivery_second_look",
    """
with e as (select event_id, user_id as u, value, event_type, ((extract(hour from ts) + 17) % 24) = 7 as inside from events)
select event_id, case when u % 11 = 0 then 'ALREADY_SENT' when u % 2 = 0 and not inside then 'HELD_SEND_WINDOW_EXPIRED' when event_type = 'error' then 'HELD_SOURCE_HEALTH_CHANGED' when u % 5 = 0 then 'HELD_TEST_MODE_CHANGED'
  when value < 5 then 'HELD_SHEET_SEND_DISABLED' when u % 7 = 0 then 'HELD_NO_RECIPIENTS' when u % 7 = 1 then 'HELD_RECIPIENT_ERRORS' end as held from e""",
)
def delivery_second_look(spark, d):  # F14, F13, SK8
    u = F.col("user_id")
    inside = (F.hour("ts") + 17) % 24 == 7
    held = filters.second_look(u % 11 == 0, u % 2 != 0, inside, F.col("event_type") != "error", u % 5 == 0, F.col("value") >= 5, u % 7, F.when(u % 7 == 1, 1).otherwise(0))
    return table(spark, d, "events").select("event_id", held.alias("held"))


@query(
    "retry_index",
    """
with i as (select user_id, case when event_type = 'error' then ['ERROR'] when event_type = 'view' then ['NEEDS_PRIMARY_SOURCE'] else ['EVIDENCE_DROP'] end as r, case when event_id % 2 = 0 then 'v2' else 'v1' end as v from events)
select distinct user_id from events where user_id not in (select user_id from i where (list_contains(r, 'EVIDENCE_DROP') and v = 'v2') or list_contains(r, 'NEEDS_PRIMARY_SOURCE'))""",
)
def retry_index(spark, d):  # ST8, A10, U2
    e = table(spark, d, "events")
    reasons = F.when(F.col("event_type") == "error", F.array(F.lit("ERROR"))).when(F.col("event_type") == "view", F.array(F.lit("NEEDS_PRIMARY_SOURCE"))).otherwise(F.array(F.lit("EVIDENCE_DROP")))
    index = e.select("user_id", F.lit("evidence_guard").alias("stage"), reasons.alias("reasons"), F.when(F.col("event_id") % 2 == 0, "v2").otherwise("v1").alias("policy_version"))
    held = keys.key_index([keys.retryable(index, "v2", False).select("user_id")])
    return e.select("user_id").distinct().join(held, "user_id", "left_anti")


@query(
    "candidate_index",
    "select k, v from (select 'event' as k, cast(event_id as varchar) as v from events where event_type = 'purchase' union select 'hash', sha256(props) from events where event_type <> 'error')",
)
def candidate_index(spark, d):  # A10, U1, U2
    e = table(spark, d, "events")
    return keys.key_index([e.where("event_type = 'purchase'").select(F.lit("event").alias("k"), F.col("event_id").cast("string").alias("v")), e.where("event_type <> 'error'").select(F.lit("hash").alias("k"), F.sha2("props", 256).alias("v"))])


@query(
    "best_event_per_key",
    "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by floor(value / 10) desc, ts desc, event_id) as n from events) where n = 1",
)
def best_event_per_key(spark, d):  # W2
    return keys.best(table(spark, d, "events"), ["user_id"], [F.desc(F.floor(F.col("value") / 10)), F.desc("ts")], "event_id").select("user_id", "event_id", "value")


@query(
    "anti_published",
    """
with p as (select user_id, props, event_id from events where event_type = 'signup')
select event_id from events where event_type <> 'signup' and cast(user_id as varchar) not in (select cast(user_id as varchar) from p where event_id % 3 = 0) and props not in (select props from p where event_id % 3 = 1)""",
)
def anti_published(spark, d):  # J4
    e = table(spark, d, "events")
    p = e.where("event_type = 'signup'")
    history = p.select(F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("raw_id"), F.when(F.col("event_id") % 3 == 1, F.col("props")).alias("content"), F.lit(" ").alias("other_id"))
    return keys.unpublished(e.where("event_type <> 'signup'"), history, {"user_id": ["raw_id", "other_id"], "props": ["content"]}).select("event_id")


@query(
    "run_counters",
    """select count(*) as events, count(*) filter (where event_type = 'error') as errors, count(distinct user_id) as jobs, count(distinct props) as payloads, round(avg(case when event_type <> 'error' then 1 else 0 end), 6) as ok_ratio, bool_or(value > 99) as any_top from events""",
)
def run_counters(spark, d):  # A1, A2, A9
    ok = F.col("event_type") != "error"
    return table(spark, d, "events").agg(F.count("*").alias("events"), F.count_if(~ok).alias("errors"), F.count_distinct("user_id").alias("jobs"), F.count_distinct("props").alias("payloads"), F.round(F.avg(ok.cast("int")), 6).alias("ok_ratio"), F.bool_or(F.col("value") > 99).alias("any_top"))


@query("state_snapshot", "select event_type, count(*) as n, max(ts) as newest, min(ts) as oldest from events group by event_type")
def state_snapshot(spark, d):  # A18
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.min("ts").alias("oldest"))


@query("run_records", "select event_id, strftime(ts, 'RUN-PIPE-%Y%m%dT%H%M%SZ') as run_id, 'digest-' || strftime(ts, '%Y-%m-%d') || '-' || event_type as send_id, case when event_type = 'view' then null else ts end as completed_at from events")
def run_records(spark, d):  # S29, F32
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "view", "READY_TO_SEND").otherwise("SENT")
    return table(spark, d, "events").select("event_id", tx.run_id(ts, F.lit("RUN"), "PIPE").alias("run_id"), tx.send_id(ts, F.col("event_type"), "digest").alias("send_id"), runs.run_record(status, ts).cast("timestamp_ntz").alias("completed_at"))

"""Predicates: relevance, freshness, eligibility, admission, gates, hosts, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def excluded(padded: Column, phrases: list[str]) -> Column:  # F5
    """Any phrase as a whole run of words; these have no least length."""
    held = [F.contains(padded, F.concat(F.lit(" "), F.trim(tx.padded_words(F.lit(p))), F.lit(" "))) for p in phrases]
    return F.lit(False) if not held else F.greatest(*held, F.lit(False))


def relevant(candidates: DataFrame, rules: DataFrame, strict: DataFrame, text: Column) -> DataFrame:  # F6
    """Rules (source_id, group_no, term): every group of a strict source has to match in some term of three characters or
    more. Strict sources without rules lose their rows, other sources keep them. Adds `relevant`."""
    groups = rules.groupBy("source_id", "group_no").agg(F.collect_list("term").alias("terms")).groupBy("source_id").agg(F.collect_list("terms").alias("groups"))
    joined = candidates.withColumn("_padded", tx.padded_words(text)).join(groups, "source_id", "left").join(strict.select("source_id", F.lit(True).alias("_strict")).distinct(), "source_id", "left")
    met = F.forall("groups", lambda g: F.exists(g, lambda t: tx.has_term(F.col("_padded"), t)))
    return joined.withColumn("relevant", F.when(F.col("_strict").isNull(), True).otherwise(F.coalesce(met, F.lit(False)))).drop("_padded", "_strict", "groups")


# Fixed value: how titles name a day.
TITLE_DATE = r"(?i)\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+20\d{2})\b"


def observed(published: Column, title: Column, retrieved: Column, items_of_job: Column) -> Column:  # F7
    """The published instant, else a date in the title, else the time of retrieval if the job had one item."""
    iso = F.try_to_timestamp(F.regexp_extract(title, r"\b(20\d{2}-\d{2}-\d{2})\b", 1), F.lit("yyyy-MM-dd"))
    named = F.regexp_replace(F.regexp_extract(title, TITLE_DATE, 1), r"\s+", " ")
    long = F.coalesce(F.try_to_timestamp(named, F.lit("MMMM d, yyyy")), F.try_to_timestamp(named, F.lit("MMM d, yyyy")))
    return F.coalesce(published, iso, long, F.when(items_of_job == 1, retrieved))


def fresh(seen: Column, title: Column, cutoff: Column, now: Column) -> Column:  # F7, ST6
    markup = F.coalesce(title, F.lit("")).rlike("<[A-Za-z/!]")
    return F.coalesce(~markup & (seen >= cutoff) & (seen <= now + F.expr("INTERVAL 1 HOUR")), F.lit(False))


def window_start(now: Column, last_sent: Column, editorial: Column) -> Column:  # F8, ST4
    """Eight days back for editors; otherwise the last edition or 96 hours, but no more than eight days. It may move back,
    so it is a filter and no watermark."""
    floor = now - F.expr("INTERVAL 8 DAYS")
    return F.when(editorial, floor).otherwise(F.greatest(floor, F.coalesce(last_sent, now - F.expr("INTERVAL 96 HOURS"))))


def eligible(events: DataFrame, cutoff: Column, test_marker: str = "TEST-") -> DataFrame:  # F9
    """Verified events that may be published, newest first by published_at or observed_at."""
    seen = F.coalesce("published_at", "observed_at")
    kept = events.where((F.col("status") == "ELIGIBLE") & F.col("decision").isin("KEEP", "ACCEPT") & ~F.coalesce("needs_primary_source", F.lit(False)) & (seen >= cutoff) & ~F.startswith(F.coalesce("run_id", F.lit("")), F.lit(test_marker)))
    whole = (F.size(F.coalesce("facts", F.array())) > 0) & (F.size(F.coalesce("source_ids", F.array().cast("array<string>"))) > 0) & tx.blank_to_null(F.col("canonical_url")).isNotNull()
    return kept.where(whole).withColumn("seen_at", seen)


def published_history(stories: DataFrame, cutoff: Column) -> DataFrame:  # F10
    at = F.coalesce("included_at", "selected_at", "published_at", F.col("digest_date").cast("timestamp"))
    return stories.where(F.col("status").isin("SENT", "PUBLISHED")).withColumn("history_at", at).where(F.col("history_at") >= cutoff)


def admitted(decision: Column, needs_primary: Column, tier: Column, confidence: Column, facts: Column, source_ids: Column, url: Column) -> Column:  # F11
    complete = F.exists(facts, lambda f: (f["fact_id"] != "") & (f["claim"] != "") & (f["exact_quote"] != "") & F.startswith(f["source_url"], F.lit("https://")))
    return F.coalesce(decision.isin("KEEP", "ACCEPT") & ~needs_primary & tier.isin("A", "B", "C") & ((tier != "C") | (confidence >= 80)) & complete & (F.size(source_ids) > 0) & F.startswith(url, F.lit("https://")), F.lit(False))


def inside_hour(ts: Column, zone: str, hour: int) -> Column:  # F12
    return F.hour(F.from_utc_timestamp(ts, zone)) == hour


def inside_send_window(ts: Column, zone: str, hour: int, minutes: int) -> Column:  # F13
    """Monday, Wednesday or Friday in the local hour's first minutes."""
    local = F.from_utc_timestamp(ts, zone)
    return F.weekday(local).isin(0, 2, 4) & (F.hour(local) == hour) & (F.minute(local) < minutes)


def held_reason(checks: list[tuple[Column, str]]) -> Column:  # F14
    """The first reason that holds; null if delivery may go on. The order is part of the meaning."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, reason in checks:
        out = out.when(condition, F.lit(reason))
    return out


def canary_verdict(items: DataFrame, job: str, url: str, published: str, source_url: str) -> DataFrame:  # F15, A14
    """Per job: items, dated items, different URLs, and EMPTY, UNDATED or COLLAPSED if something is wrong."""
    by = items.groupBy(job).agg(F.count(url).alias("items"), F.count(published).alias("dated"), F.count_distinct(url).alias("urls"), F.min(url).alias("least_url"), F.min(source_url).alias("source_url"))
    verdict = F.when(F.col("items") == 0, "EMPTY").when(F.col("dated") == 0, "UNDATED").when((F.col("urls") == 1) & ((F.col("items") > 1) | (F.col("least_url") == F.col("source_url"))), "COLLAPSED")
    return by.withColumn("verdict", verdict)


def host_allowed(host: Column, domains: Column) -> Column:  # F16
    """One of the domains or a true subdomain of one."""
    return F.coalesce(F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def safe_url(url: Column) -> Column:  # F17
    """https, no credentials, port 443 or none, a public-looking host, no control characters or backslashes."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    host, port = F.lower(F.regexp_replace(authority, r":\d*$", "")), F.regexp_extract(authority, r":(\d*)$", 1)
    return F.coalesce(F.startswith(F.lower(url), F.lit("https://")) & (authority != "") & ~authority.contains("@") & port.isin("", "443") & (host != "localhost") & ~F.endswith(host, F.lit(".localhost")) & ~F.endswith(host, F.lit(".local")) & ~url.rlike(r"[\x00-\x20\x7f\\]"), F.lit(False))


#: IPv4 ranges that are not public, as first and last number.
PRIVATE_RANGES = {"0.0.0.0": 8, "10.0.0.0": 8, "100.64.0.0": 10, "127.0.0.0": 8, "169.254.0.0": 16, "172.16.0.0": 12, "192.0.0.0": 24, "192.0.2.0": 24, "192.168.0.0": 16, "198.18.0.0": 15, "198.51.100.0": 24, "203.0.113.0": 24, "224.0.0.0": 4, "240.0.0.0": 4}


def public_ipv4(address: Column) -> Column:  # F18
    parts = F.split(address, r"\.")
    number = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    valid = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    private = F.lit(False)
    for base, bits in PRIVATE_RANGES.items():
        start = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        private = private | number.between(start, start + (1 << (32 - bits)) - 1)
    return F.coalesce(valid & ~private, F.lit(False))


def public_address(address: Column) -> Column:  # F18
    """IPv4 by its ranges; addresses with a colon, mapped ones among them, by the library."""
    from tidewell.functions import python

    return F.when(F.contains(address, F.lit(":")), python.public_udf(address)).otherwise(public_ipv4(address))


def second_look(already_sent: Column, once: Column, in_window: Column, healthy: Column, test_mode: Column, send_enabled: Column, recipients: Column, rejected: Column) -> Column:  # F14, SK8
    """Why an edition that was ready is held after all, as of what sheet, health and clock say right before it goes out; null: it goes. An
    unknown switch counts as not set, an unknown test mode as test."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(already_sent), "ALREADY_SENT")
        .when(~yes(once) & ~yes(in_window), "HELD_SEND_WINDOW_EXPIRED")
        .when(~yes(healthy), "HELD_SOURCE_HEALTH_CHANGED")
        .when(F.coalesce(test_mode, F.lit(True)), "HELD_TEST_MODE_CHANGED")
        .when(~yes(send_enabled), "HELD_SHEET_SEND_DISABLED")
        .when(F.coalesce(recipients, F.lit(0)) == 0, "HELD_NO_RECIPIENTS")
        .when(F.coalesce(rejected, F.lit(0)) > 0, "HELD_RECIPIENT_ERRORS")
    )


def leaks(text: Column, forbidden: list[str]) -> Column:  # F19
    values = [v.lower() for v in forbidden if v]
    return F.lit(False) if not values else F.greatest(*(F.contains(F.lower(text), F.lit(v)) for v in values), F.lit(False))


def warnings(text: Column) -> Column:  # F20
    """A warning for text that addresses the model; the row stays."""
    return F.when(text.rlike(tx.INJECTION), F.array(F.lit("PROMPT_INJECTION_TEXT_PRESENT"))).otherwise(F.array().cast("array<string>"))


def namespace(run_id: Column, test: bool, marker: str = "TEST-") -> Column:  # F21
    return F.startswith(run_id, F.lit(marker)) == F.lit(test)


def packet(df: DataFrame, caps: dict[str, int], plain: list[str]) -> DataFrame:  # F22
    return df.select(*plain, *(tx.truncated(F.col(c), n).alias(c) for c, n in caps.items()))


def effective_test(sheet: Column, environment: Column) -> Column:  # F30
    return F.coalesce(sheet, F.lit(True)) | environment

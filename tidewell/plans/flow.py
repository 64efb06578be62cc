"""The whole flow as one plan over tables: payloads to candidates, candidates to selection, annotations to events, events
to an edition. Fetching, annotating and drafting are inputs; every arrow is a function of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import evidence, filters, keys, rank, select
from tidewell.plans.registry import query, table
from tidewell.sources import candidates as cd
from tidewell.sources import parsers


# Fixed value: candidates that a run reviews at most, whatever it asks for.
MOST_REVIEWS = 60


@dataclass(frozen=True)
class Params:
    """Everything that a run does not read from tables. as_of is a literal, so a run can be repeated."""

    run_id: str
    as_of: str
    policy_version: str = "v3"
    reviews: int = 60
    web_reserve: int = 8
    debt_reserve: int = 4
    editorial: bool = True


def collect(jobs: DataFrame, payloads: DataFrame, p: Params, lanes: tuple[str, ...] | None = None) -> DataFrame:
    """jobs and payloads (source_job_key, seq, parser_lane, url, payload, max_items) to candidates."""
    return cd.candidates(parsers.parse(payloads, lanes), jobs, p.run_id, F.lit(p.as_of))


def novel(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that neither history (candidate_id, content_sha256) nor an earlier one of this run has."""
    fresh = keys.unknown(candidates, known, known, "candidate_id", "content_sha256").withColumn("place", F.struct("source_job_key", "seq", "n"))
    return keys.first(keys.first(fresh, ["candidate_id"], "place"), ["content_sha256"], "place").drop("place")


def screened(candidates: DataFrame, rules: DataFrame, strict: DataFrame, excluded: list[str], last_sent: Column, p: Params) -> DataFrame:
    """Relevant and fresh candidates. Items are counted per job before anything is dropped."""
    now = F.lit(p.as_of).cast("timestamp")
    counted = candidates.withColumn("items_of_job", F.count("*").over(Window.partitionBy("source_job_key")))
    text = F.concat_ws(" ", "title", "summary_text")
    kept = filters.relevant(counted, rules, strict, text).where(F.col("relevant") & ~filters.excluded(tx.padded_words(text), excluded))
    seen = filters.observed(F.col("published_at"), F.col("title"), F.col("retrieved_at"), F.col("items_of_job"))
    return kept.where(filters.fresh(seen, F.col("title"), filters.window_start(now, last_sent, F.lit(p.editorial)), now)).drop("relevant", "items_of_job")


def selected(candidates: DataFrame, watch_terms: DataFrame, p: Params) -> DataFrame:
    """At most `reviews` candidates: general registry sources first, then places kept for secondary reports of deals and for web finds, as far as
    there are any, then whatever is left, first one a source, then a second."""
    watched = cd.watch_hits(candidates, watch_terms, F.concat_ws(" ", "title", "summary_text", "body_text"), "candidate_id")
    scored = watched.withColumn("signal", select.priority_signal(F.col("section"), F.col("title"), F.col("summary_text"))).withColumn("lane", tx.operating_lane(F.col("section")))
    web = F.startswith("source_id", F.lit("WEB-"))
    debt = ~web & (F.col("section") == "deal_tape") & ~F.col("primary_source") & ~F.col("discovery_only") & F.col("source_class").isin("B", "C")
    debt = F.coalesce(debt, F.lit(False))
    there = candidates.agg(F.count_if(web).alias("web"), F.count_if(debt).alias("debt")).first()
    n = min(p.reviews, MOST_REVIEWS)
    kept_web = min(p.web_reserve, there["web"], n)
    kept_debt = min(p.debt_reserve, there["debt"], max(0, n - kept_web))
    passes = [select.Pass(~web & ~debt, n - kept_web - kept_debt), select.Pass(debt, n - kept_web, kept_debt), select.Pass(web, n, kept_web), select.Pass(F.lit(True), n), select.Pass(F.lit(True), n, per_source=2)]
    place = select.candidate_place("hits", "primary_source", "priority", "signal", "published_at", "candidate_id")
    return select.balanced(scored, passes, place, "candidate_id", "canonical_url", "content_sha256", "source_job_key")


def verified(selection: DataFrame, analysis: DataFrame, text: Column) -> DataFrame:
    """Annotated candidates with their reason codes."""
    return evidence.annotated(selection, analysis).withColumn("codes", evidence.evidence_codes(text))


def ranked(events: DataFrame, history: DataFrame, p: Params, limit: int = 60) -> DataFrame:
    """Unpublished events in order of score (none: confidence), recency and id."""
    left = keys.unpublished(events, history, {"event_id": ["raw_event_id", "event_id", "candidate_id"], "candidate_id": ["raw_event_id", "event_id", "candidate_id"], "content_hash": ["content_hash"], "canonical_url": ["canonical_url"]})
    recent = left.withColumn("recency", rank.recency(F.lit(p.as_of).cast("timestamp"), F.col("published_at")))
    return rank.rank(recent.withColumn("score", F.coalesce("editorial_score", *(["confidence"] if "confidence" in events.columns else []), F.lit(0))), "event_id", "score", "recency", "event_id", limit)


@query("page_candidates")
def page_candidates(spark, d):
    """Pages as fetched documents of one job a host: parsed, made candidates, without known and repeated ones."""
    pages = table(spark, d, "pages")
    host = tx.url_host(F.col("url"))
    jobs = pages.select(host.alias("source_job_key")).distinct().select("source_job_key", F.col("source_job_key").alias("source_id"), F.lit("ai_radar").alias("section"), F.lit("P1").alias("priority"), F.lit(True).alias("primary_source"), F.lit(False).alias("discovery_only"), F.array(F.regexp_replace("source_job_key", r"^(www|m)\.", "")).alias("allowed_domains"), F.concat(F.lit("https://"), "source_job_key", F.lit("/")).alias("resolved_url"))
    payloads = pages.select(host.alias("source_job_key"), F.col("page_id").alias("seq"), F.lit("document").alias("parser_lane"), "url", F.col("html").alias("payload"), F.lit(1).alias("max_items"))
    made = collect(jobs, payloads, Params("RUN-1", "2024-01-25 00:00:00"), ("document",))
    known = made.where("false").select("candidate_id", "content_sha256")
    return novel(made, known).select("source_job_key", "candidate_id", "canonical_url", "content_sha256", F.length("body_text").alias("n_body"))

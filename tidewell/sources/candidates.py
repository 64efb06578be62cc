"""Items become candidates; undated cards take what a fetched detail page knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import filters, keys, select


def candidates(items: DataFrame, jobs: DataFrame, run_id: str, retrieved_at) -> DataFrame:  # SC20, S12, S13, S32
    """Candidates of items joined to their job: canonical URL (the job's own where the host is not allowed), capped texts,
    content hash and id; the first row of each id within a job stays."""
    tier = (F.col("source_class") if "source_class" in jobs.columns else F.lit(None).cast("string")).alias("source_class")
    joined = items.where("error is null and title is not null").join(jobs.select("source_job_key", "source_id", "section", "priority", "primary_source", "discovery_only", "allowed_domains", "resolved_url", tier), "source_job_key")
    url = tx.canonical_url(F.col("url"))
    url = F.when(filters.host_allowed(tx.url_host(url), F.col("allowed_domains")), url).otherwise(tx.canonical_url(F.col("resolved_url")))
    title, body = tx.truncated(tx.collapse(F.col("title")), 500), tx.truncated(F.col("body"), 50_000)
    made = joined.select(
        F.lit(run_id).alias("run_id"), "source_id", "source_job_key", "section", "priority", "primary_source", "discovery_only", "source_class", "item_id", "seq", "n",
        url.alias("canonical_url"), title.alias("title"), tx.truncated(F.col("summary"), 5_000).alias("summary_text"), body.alias("body_text"),
        tx.parse_lenient_time(F.col("published")).alias("published_at"), F.lit(retrieved_at).cast("timestamp").alias("retrieved_at"),
        tx.revision_hash(title, body).alias("content_sha256"), filters.warnings(F.concat_ws(" ", "title", "summary", "body")).alias("parse_warnings"),
    )
    made = made.withColumn("candidate_id", tx.candidate_key(F.col("source_id"), F.col("item_id"), F.col("content_sha256"))).withColumn("place", F.struct("seq", "n"))
    return keys.first(made, ["source_job_key", "candidate_id"], "place").drop("place")


def hydrated(items: DataFrame, details: DataFrame, key: str, seq: str, budget: int) -> DataFrame:  # SC18, W12
    """Undated items, the first `budget` of each key, take the detail page's date, and its body where that is longer."""
    asked = select.budgeted(items, key, seq, F.col("published").isNull(), budget)
    found = details.select(F.col("url").alias("_u"), F.col("published").alias("_published"), F.col("body").alias("_body"))
    joined = asked.join(found, F.col("looked_up") & (F.col("url") == F.col("_u")), "left")
    longer = F.length("_body") > F.length(F.coalesce("body", F.lit("")))
    return joined.withColumn("published", F.coalesce("published", "_published")).withColumn("body", F.when(longer, F.col("_body")).otherwise(F.col("body"))).drop("_u", "_published", "_body", "looked_up")


#: Terms up to which they go to all executors; watchlists are shorter by far. More of them are joined by a shuffle.
FEW_TERMS = 100_000
#: Terms up to which each text is searched for them; beyond that every run of its words is a row, and an equi-join tells.
LISTED = 500


def watch_terms(company: DataFrame, deposit: DataFrame) -> DataFrame:  # J6
    """Terms (name, term, place) of two watchlists (seq, label, aliases): companies first, each list in its order. A
    row without a label has none; a name holds its list, and 80 characters of the label without control characters."""
    both = company.withColumn("_p", F.lit("company")).withColumn("_l", F.lit(0)).unionByName(deposit.withColumn("_p", F.lit("deposit")).withColumn("_l", F.lit(1)))
    label = F.trim("label")
    safe = F.substring(F.trim(F.regexp_replace(label, r"[\x00-\x1f\x7f]+", " ")), 1, 80)
    terms = F.concat(F.array(label), F.coalesce("aliases", F.array().cast("array<string>")))
    return both.where(label != "").select(F.concat_ws(":", "_p", safe).alias("name"), F.explode(terms).alias("term"), F.struct("_l", "seq").alias("place"))


def watch_hits(candidates_: DataFrame, terms: DataFrame, text, key: str, most: int = 20) -> DataFrame:  # J6, S19
    """`hits`: names of the terms (name, term, and place where they have an order) whose words occur in the text as a run,
    20 at most, in order of place, otherwise of name. Long lists meet word runs in an equi-join instead of a containment join;
    terms under three characters never match. Terms may have any number of words: runs are made of the sizes that occur."""
    named = terms.withColumn("_t", F.trim(tx.padded_words(F.col("term")))).where(F.length("_t") >= 3).withColumn("_size", F.size(F.split("_t", " ")))
    named = named.withColumn("_place", F.col("place") if "place" in terms.columns else F.col("name")).groupBy("_t", "_size", "name").agg(F.min("_place").alias("_place"))
    sizes = {r["_size"]: r["n"] for r in named.groupBy("_size").agg(F.count("*").alias("n")).collect()}  # a number a size
    wanted = F.broadcast(named) if sum(sizes.values()) <= FEW_TERMS else named
    padded = candidates_.select(key, tx.padded_words(text).alias("_p"))
    # Outer explodes, as Spark would put the size of an inner one's array, made a second time, into a filter before it.
    if sum(sizes.values()) <= LISTED:
        listed = padded.crossJoin(F.broadcast(named.agg(F.collect_set(F.concat(F.lit(" "), "_t", F.lit(" "))).alias("_terms"))))  # one row
        runs = listed.select(key, F.explode_outer(F.filter("_terms", lambda t: F.contains(F.col("_p"), t))).alias("_t")).withColumn("_t", F.trim("_t"))
    else:
        words = padded.select(key, F.split(F.trim("_p"), " ").alias("_w"))
        runs = words.select(key, F.explode_outer(F.flatten(F.array(*(tx.word_runs(F.col("_w"), k) for k in sorted(sizes))))).alias("_t"))
    runs = runs.where("_t is not null")
    met = runs.join(wanted.drop("_size"), "_t").groupBy(key, "name").agg(F.min("_place").alias("_place"))
    found = met.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_place", "name"))), 1, most), lambda x: x["name"]).alias("hits"))
    return candidates_.join(found, key, "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)))


def grounded_leads(leads: DataFrame, cited: DataFrame, most: int = 8) -> DataFrame:  # J9, SC19, S11, S25
    """Leads (seq, headline, source_url) with the cited URL of the same host, path and query, else the one of the same host
    whose title shares most words, if it is the only one of the host or shares half; distinct URLs, `most` of them."""
    keyed = leads.withColumn("_k", tx.url_key(F.col("source_url")))
    with_key = cited.select(F.col("url").alias("cited_url"), F.col("title").alias("cited_title"), tx.url_key(F.col("url")).alias("_c"))
    exact = keyed.join(with_key, F.col("_k") == F.col("_c")).groupBy("seq").agg(F.min("cited_url").alias("exact_url"))
    score = tx.token_overlap(tx.token_set(F.col("headline")), tx.token_set(F.col("cited_title")))
    near = keyed.join(with_key, F.col("_k.host") == F.col("_c.host")).groupBy("seq").agg(F.max(F.struct(score.alias("score"), "cited_url")).alias("x"), F.count("*").alias("m"))
    near = near.select("seq", F.when((F.col("m") == 1) | (F.col("x.score") >= 0.5), F.col("x.cited_url")).alias("near_url"))
    out = keyed.drop("_k").join(exact, "seq", "left").join(near, "seq", "left").withColumn("grounded_url", F.coalesce("exact_url", "near_url")).where("grounded_url is not null").drop("exact_url", "near_url")
    return keys.first(out, ["grounded_url"], "seq").orderBy("seq").limit(most)

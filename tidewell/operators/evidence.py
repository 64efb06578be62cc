"""Checks of externally supplied annotations against their source texts, and the events made of those that pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx

FACTS = "array<struct<fact_id:string,claim:string,exact_quote:string,source_url:string>>"
AMOUNTS = "array<struct<kind:string,amount:double,currency:string,fact_id:string,source_text:string>>"


def contained(needle: Column, haystack: Column) -> Column:
    """Whether the grounded needle, which must not be blank, occurs in the grounded haystack."""
    own = tx.grounded(needle)
    return (own != "") & F.contains(tx.grounded(haystack), own)


def evidence_codes(text: Column) -> Column:  # F23, J11
    """Reason codes of an annotation joined to its candidate. Columns: candidate_id, expected_id, decision, section,
    event_type, facts, amounts, approved_urls, discovery_only, primary_source, source_class, confidence, borrower,
    lenders, entities, rate, maturity, event_date, published_at. An empty array means valid."""
    keep = F.col("decision") == "KEEP"
    facts, amounts = F.col("facts"), F.col("amounts")
    ids = F.transform(facts, lambda f: f["fact_id"])
    quote = lambda fact_id: F.get(F.filter(facts, lambda f: f["fact_id"] == fact_id), F.lit(0))["exact_quote"]
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    secondary = keep & (F.col("section") == "deal_tape") & ~F.col("primary_source")
    value = lambda a: F.struct(a["amount"].cast("string").cast("decimal(38,6)").alias("amount"), F.upper(a["currency"]).alias("currency"))
    finite = lambda a: ~F.isnan(a["amount"]) & (F.abs(a["amount"]) < float("inf"))
    return tx.codes(
        (F.col("decision").isNull() | ~F.col("decision").isin("KEEP", "DROP", "NEEDS_PRIMARY_SOURCE"), "SCHEMA_INVALID"),
        (F.col("candidate_id") != F.col("expected_id"), "CANDIDATE_ID_MISMATCH"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_FACT_ID"),
        (F.exists(facts, lambda f: ~F.array_contains("approved_urls", f["source_url"])), "UNAPPROVED_FACT_URL"),
        (F.exists(facts, lambda f: ~contained(f["exact_quote"], text)), "QUOTE_NOT_IN_SOURCE"),
        (keep & (F.size(facts) == 0), "KEEP_WITHOUT_FACTS"),
        (keep & F.coalesce(F.col("section") == "none", F.lit(True)), "KEEP_WITHOUT_REAL_SECTION"),
        (keep & ~filled("event_type"), "KEEP_WITHOUT_EVENT_TYPE"),
        (keep & F.col("discovery_only"), "DISCOVERY_ITEM_CANNOT_BE_KEPT"),
        ((F.col("decision") == "NEEDS_PRIMARY_SOURCE") & F.col("primary_source"), "PRIMARY_SOURCE_CANNOT_NEED_PRIMARY"),
        (secondary & ~F.col("source_class").isin("B", "C"), "DEAL_TAPE_SECONDARY_SOURCE_TOO_WEAK"),
        (secondary & (F.col("confidence") < 75), "DEAL_TAPE_SECONDARY_CONFIDENCE_TOO_LOW"),
        (keep & (F.col("section") == "deal_tape") & (~filled("borrower") | (F.size("lenders") == 0)), "DEAL_TAPE_MISSING_PARTIES"),
        (keep & (F.col("section") == "deal_tape") & (filled("borrower") & ~contained(F.col("borrower"), text) | F.exists("lenders", lambda x: ~contained(x, text))), "DEAL_TAPE_PARTY_NOT_IN_SOURCE"),
        (F.exists("entities", lambda x: (F.trim(x) != "") & ~contained(x, text)), "ENTITY_NOT_IN_SOURCE"),
        (F.exists(amounts, lambda a: ~finite(a)), "AMOUNT_NOT_FINITE"),
        (F.exists(amounts, lambda a: finite(a) & ~F.array_contains(ids, a["fact_id"])), "AMOUNT_FACT_ID_UNKNOWN"),
        (F.exists(amounts, lambda a: finite(a) & F.array_contains(ids, a["fact_id"]) & ~contained(a["source_text"], quote(a["fact_id"]))), "AMOUNT_TEXT_NOT_IN_FACT"),
        (F.exists(amounts, lambda a: a["amount"] < 0), "AMOUNT_INVALID"),
        (F.exists(amounts, lambda a: finite(a) & F.array_contains(ids, a["fact_id"]) & ~F.array_contains(tx.amounts(a["source_text"]), value(a))), "AMOUNT_NOT_SOURCE_DERIVED"),
        (keep & F.exists(amounts, lambda a: a["kind"] == "equity_raised") & (F.col("section") != "runway_watch"), "EQUITY_RAISE_REQUIRES_RUNWAY_WATCH"),
        (filled("rate") & ~contained(F.col("rate"), text), "RATE_NOT_IN_SOURCE"),
        (filled("maturity") & ~contained(F.col("maturity"), text), "MATURITY_NOT_IN_SOURCE"),
        (filled("event_date") & ~contained(F.col("event_date"), text) & ~F.coalesce(F.contains(F.col("published_at").cast("string"), F.col("event_date")), F.lit(False)), "EVENT_DATE_NOT_IN_SOURCE"),
    )


def events_of(checked: DataFrame) -> DataFrame:  # F26
    """Events of annotations without codes that are kept in a real section, with the two amount kinds as columns. `codes`
    keeps what speaks against the construction: a kind twice, or two currencies."""
    kept = checked.where((F.size("codes") == 0) & (F.col("decision") == "KEEP") & (F.col("section") != "none"))
    mapped = F.filter("amounts", lambda a: a["kind"].isin("total_commitment", "initial_funding"))
    kinds, currencies = F.transform("amounts", lambda a: a["kind"]), F.transform(mapped, lambda a: a["currency"])
    one = lambda kind: F.get(F.filter("amounts", lambda a: a["kind"] == kind), F.lit(0))["amount"].cast("string").cast("decimal(38,6)").alias(kind)
    return kept.select(
        "*",
        one("total_commitment"),
        one("initial_funding"),
        F.get(currencies, F.lit(0)).alias("currency"),
        tx.codes((F.size(F.array_distinct(kinds)) < F.size(kinds), "DUPLICATE_AMOUNT_KIND"), (F.size(F.array_distinct(currencies)) > 1, "EVENT_AMOUNTS_HAVE_MULTIPLE_CURRENCIES")).alias("event_codes"),
    )


def events_of_rows(raw: DataFrame) -> DataFrame:  # F28
    """Typed events from stored all-text rows: facts from JSON, legacy ACCEPT as KEEP, unknown states as `unknown`; rows
    without an id or facts are skipped."""
    notes = F.from_json("notes", f"struct<verified_facts:{FACTS}>")
    facts = F.transform(notes["verified_facts"], lambda f: F.struct(f["fact_id"].alias("fact_id"), F.coalesce(f["claim"], f["exact_quote"]).alias("claim"), F.coalesce(f["exact_quote"], f["claim"]).alias("exact_quote"), F.coalesce(f["source_url"], F.col("canonical_url")).alias("source_url")))
    status = F.lower(F.trim("event_status"))
    known = ("announced", "approved", "signed", "closed", "funded", "drawn", "launched", "proposed", "unknown")
    out = raw.select(
        tx.blank_to_null(F.col("event_id")).alias("event_id"),
        tx.blank_to_null(F.col("candidate_id")).alias("candidate_id"),
        F.when(F.upper("agent_decision") == "ACCEPT", "KEEP").otherwise(F.upper("agent_decision")).alias("decision"),
        F.when(status.isin(*known), status).otherwise("unknown").alias("event_status"),
        tx.optional_int(F.col("confidence")).alias("confidence"),
        F.coalesce(tx.optional_int(F.col("editorial_score")), F.lit(0)).alias("editorial_score"),
        tx.parse_cell_time(F.col("published_at")).alias("published_at"),
        tx.parse_list(F.col("source_ids")).alias("source_ids"),
        facts.alias("facts"),
    )
    return out.where(F.col("event_id").isNotNull() & (F.size(F.coalesce("facts", F.array().cast(FACTS))) > 0))


def contract_codes() -> Column:  # F27
    """Bounds and cross-field rules of stored events and sources."""
    return tx.codes(
        (F.col("primary_source") & F.col("discovery_only"), "PRIMARY_AND_DISCOVERY"),
        ((F.col("decision") == "KEEP") & ((F.size("facts") == 0) | (F.size("source_ids") == 0)), "KEEP_WITHOUT_FACTS"),
        (~F.col("confidence").between(0, 100), "CONFIDENCE_OUT_OF_RANGE"),
        (~F.col("editorial_score").between(0, 100), "SCORE_OUT_OF_RANGE"),
        (~F.startswith(F.col("url"), F.lit("https://")) | F.col("url").rlike(r"[\\\x00-\x1f]"), "URL_NOT_HTTPS"),
    )


def annotated(selected: DataFrame, analysis: DataFrame) -> DataFrame:  # X1
    """Annotations are an input table; every selected candidate keeps its row, with `annotated` false where none came."""
    return selected.join(analysis.withColumn("annotated", F.lit(True)), "candidate_id", "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))


def quoted(texts: DataFrame, quotes: DataFrame, key: str, text: str, quote_key: str, quote: str) -> DataFrame:  # F23 in part, S20
    """Pairs (key, quote_key) of texts and quotes, both of words with a blank between them, where the text has the quote as
    whole words. The first words of a quote, five or as many as it has, meet the runs of words of that size; containment
    is then tested. Texts are not shuffled while the pairs so found are few."""
    led = quotes.select(quote_key, F.col(quote).alias("_q"), F.split(quote, " ").alias("_w")).where("_q <> ''").withColumn("_size", F.least(F.lit(5), F.size("_w")))
    led = led.withColumn("_k", F.array_join(F.slice("_w", F.lit(1), F.col("_size")), " ")).drop("_w")
    words = F.split(text, " ")
    sizes = sorted(r["_size"] for r in led.select("_size").distinct().collect()) or [1]  # five numbers at most
    runs = texts.select(key, F.explode(F.flatten(F.array(*(tx.word_runs(words, k) for k in sizes)))).alias("_k"))
    met = runs.join(led.select(quote_key, "_k"), "_k").select(key, quote_key).distinct()
    held = texts.select(key, text).join(met, key).join(led.select(quote_key, "_q"), quote_key)
    return held.where(F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), "_q", F.lit(" ")))).select(key, quote_key)


def after_repair(answers: DataFrame, key: str, turn: str = "turn", codes: str = "codes") -> DataFrame:  # X1, X2, X3
    """Of the answers to one request, a first and its repair at most, the first that no constraint rejects; where both are
    rejected the repair stays, with its codes. `accepted` tells which."""
    two = answers.where(F.col(turn) <= 2).withColumn("accepted", F.size(codes) == 0)
    order = [F.desc("accepted"), F.when(F.col("accepted"), F.col(turn)).otherwise(-F.col(turn))]
    return two.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


ANSWERS = "{key} string, turn int, answer string, error string"


def asked(requests: DataFrame, key: str, annotator: Callable[[dict], str], turn: int, at_once: int) -> DataFrame:  # X1, X2, X3
    """One answer for each request: its columns go to the annotator as a mapping. No more than `at_once` calls run at a time, since
    there are no more tasks; a call that fails is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request in batch.to_pylist():
                answer = error = None
                try:
                    answer = annotator(request)
                except Exception as e:  # noqa: BLE001  a failing call is a value
                    error = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((str(request[key]), pa.string()), (turn, pa.int32()), (answer, pa.string()), (error, pa.string()))], [key, "turn", "answer", "error"])

    return requests.repartition(at_once, key).mapInArrow(run, ANSWERS.format(key=f"`{key}`"))


def annotated_by(selected: DataFrame, key: str, annotator: Callable[[dict], str], checked: Callable[[DataFrame], DataFrame], most: int = 60, at_once: int = 4) -> DataFrame:  # X1, X2, X3
    """Answers of an injected annotator for at most `most` rows, in order of the key: a second turn, with the codes of the first as `codes`, for
    those that `checked` (answers to answers with an array of `codes`) finds at fault or that failed; of the two the one that after_repair() takes.
    Answers are kept while the plan lives, so that no call is made twice on their account; a lost executor repeats its calls."""
    limited = selected.orderBy(key).limit(most).withColumn(key, F.col(key).cast("string"))
    failed = F.when(F.col("error").isNotNull(), F.array(F.lit("CALL_FAILED"))).otherwise(F.array().cast("array<string>"))
    judge = lambda answers: checked(answers).withColumn("codes", F.array_sort(F.array_distinct(F.concat("codes", failed))))
    first = judge(asked(limited.withColumn("codes", F.array().cast("array<string>")), key, annotator, 1, at_once)).persist(StorageLevel.DISK_ONLY)
    faulty = first.where(F.size("codes") > 0).select(key, "codes")
    second = judge(asked(limited.join(faulty, key), key, annotator, 2, at_once)).persist(StorageLevel.DISK_ONLY)
    return after_repair(first.unionByName(second), key)


def completions(attempts: DataFrame, key: str, schema: str) -> DataFrame:  # X4
    """The first attempt (attempt, status, body) of each request that was answered and whose body is JSON of the schema, in
    its required fields; requests without one have a null `answer`. Retries and fallbacks are further attempts."""
    read = F.from_json("body", schema)
    names = [f.name for f in attempts.select(read.alias("x")).schema["x"].dataType.fields]
    whole = (F.col("status") == 200) & reduce(lambda a, b: a & b, [read[n].isNotNull() for n in names])
    best = F.min(F.when(whole, F.struct("attempt", read.alias("answer"))))
    return attempts.groupBy(key).agg(best.alias("x"), F.count("*").alias("attempts")).select(key, "x.answer", "attempts")

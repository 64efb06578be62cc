"""Checks of drafted stories, and the edition made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx

SECTIONS = ("lead", "deal_tape", "competitive_field", "ai_radar", "runway_watch")
# Most stories of a section and of an edition, words of an edition, least stories if there is enough.
SECTION_CAPS = {"lead": 1, "deal_tape": 15, "competitive_field": 15, "ai_radar": 15, "runway_watch": 15}
MOST_STORIES, MOST_WORDS, STORY_FLOOR = 15, 7500, 8
# Phrases that copy must not use, and what an address looks like.
BANNED = r"(?i)\b(?:game[- ]chang(?:e|er|ing)|revolutionary|transformative|disruptive|in today'?s fast[- ]paced world|reshaping the landscape|delve into|it is worth noting|who'?s eating|the works|exciting times|paradigm shift)\b"
ADDRESS = r"(?i)https?://|www\.|\b[^\s@]+@[^\s@]+\.[^\s@]+\b"


def words_in(*columns: Column) -> Column:  # A16
    return F.size(F.regexp_extract_all(F.concat_ws(" ", *columns), F.lit(r"(?U)\b[\w'-]+\b"), F.lit(0)))


# What parts a headline's company from its event, the copy of an edition whose own cannot stand, tokens named in codes.
SEPARATOR = " \u2014 "
PLAIN_HEADLINE, PLAIN_DECK = "Venture Debt + AI Daily", "Verified developments with source-linked commentary."
MOST_TOKENS, MOST_TOKEN = 8, 48


def story_codes(copy: Column, fact_text: Column, invented: Column | None = None) -> Column:  # F24, J8, U5
    """Codes of a story joined (left) to its event. Columns: event_id, known_id (null without an event), nth (the how manieth story of its
    event it is), section, event_section, fact_ids, event_fact_ids, source_ids, event_source_ids, entities, event_entities, cited_sources, headline.
    invented: names in the copy that nothing supports (unknown_names). A story without an event, and the second of one, have that code alone."""
    none = F.array().cast("array<string>")
    held = lambda c: F.coalesce(c, none)
    outside = lambda own, allowed: F.size(F.array_except(held(F.col(own)), held(F.col(allowed)))) > 0
    parted = F.contains("headline", F.lit(SEPARATOR))
    names = F.slice(F.array_sort(held(invented)), 1, MOST_TOKENS) if invented is not None else none
    token = lambda x: F.substring(F.upper(F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), F.lit("_"))), 1, MOST_TOKEN)
    said = lambda e: (tx.grounded(e) != "") & F.contains(tx.grounded(copy), tx.grounded(e))
    own = tx.codes(
        ((F.col("section") != "lead") & ~F.col("event_section").isin("lead") & (F.col("section") != F.col("event_section")), "SECTION_MISMATCH"),
        ((F.size(held(F.col("fact_ids"))) == 0) | outside("fact_ids", "event_fact_ids"), "UNSUPPORTED_FACT_ID"),
        ((F.size(held(F.col("source_ids"))) == 0) | outside("source_ids", "event_source_ids"), "UNSUPPORTED_SOURCE_ID"),
        (copy.rlike(ADDRESS), "MODEL_COPY_CONTAINS_URL_OR_EMAIL"),
        (copy.rlike(BANNED), "BANNED_OR_SLOPPY_COPY"),
        (~parted, "HEADLINE_FORMAT_INVALID"),
        (parted & ~F.array_contains(held(F.col("event_entities")), F.trim(F.substring_index("headline", SEPARATOR, 1))), "HEADLINE_COMPANY_NOT_SOURCE_ENTITY"),
        (outside("entities", "event_entities"), "UNSUPPORTED_ENTITY"),
        (F.exists(held(F.col("entities")), lambda e: ~said(e)), "DECLARED_ENTITY_NOT_IN_COPY"),
        (F.exists(F.array_except(held(F.col("event_entities")), held(F.col("entities"))), said), "COPY_ENTITY_NOT_DECLARED"),
        (F.size(F.array_except(tx.numbers(copy), tx.numbers(fact_text))) > 0, "NUMBER_NOT_IN_SELECTED_FACTS"),
        (outside("source_ids", "cited_sources"), "SOURCE_CITATION_MISSING"),
        (F.size(names) > 0, "POSSIBLE_INVENTED_ENTITY"),
    )
    own = F.array_sort(F.array_distinct(F.concat(own, F.transform(names, lambda x: F.concat(F.lit("POSSIBLE_INVENTED_ENTITY_TOKEN_"), token(x))))))
    return F.when(F.col("known_id").isNull(), F.array(F.lit("UNKNOWN_EVENT_ID"))).when(F.col("nth") > 1, F.array(F.lit("DUPLICATE_EVENT"))).otherwise(own)


def judged(stories: DataFrame, events: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:  # F24
    """Stories of drafts (draft_id, seq, section, event_id, headline, dek, why_it_matters, fact_ids, source_ids, entities) with their codes.
    events: (draft_id, event_id, section, entities, fact_ids, source_ids, sources, facts), `sources` being the ids that can be cited."""
    known = events.select("draft_id", "event_id", F.col("event_id").alias("known_id"), *(F.col(c).alias(f"event_{c}") for c in ("section", "entities", "fact_ids", "source_ids")), F.col("sources").alias("cited_sources"), "facts")
    order = [section_order(F.col("section")), F.col("seq")]
    nth = F.row_number().over(Window.partitionBy("draft_id", "event_id").orderBy(*order))
    joined = stories.join(known, ["draft_id", "event_id"], "left").withColumn("nth", nth)
    # A headline is a field of its own: its end is an end of a sentence.
    copy = F.concat_ws("\n", "headline", "dek", "why_it_matters")
    used = F.filter("facts", lambda f: F.array_contains("fact_ids", f["fact_id"]))
    facts = F.array_join(F.transform(used, lambda f: F.concat_ws(" ", f["claim"], f["exact_quote"])), " ")
    staged = joined.withColumn("copy", copy).withColumn("fact_text", F.coalesce(facts, F.lit("")))
    invented = tx.unknown_names(F.col("copy"), F.col("event_entities"), F.col("fact_text"), allowed)
    return staged.withColumn("codes", story_codes(F.col("copy"), F.col("fact_text"), invented)).drop("facts", "nth", "known_id")


def edition_codes(drafts: DataFrame, judged_stories: DataFrame, events: DataFrame) -> DataFrame:  # F24, F31
    """Drafts (draft_id, quiet, repaired, kicker, headline, deck) with the codes that stand against them as a whole (`codes`), those of their stories
    (`story_codes`), whether the edition is `accepted`, its headline and deck, and the number of its stories and words.

    Stories with codes are left out; those of a repaired draft block it no more, as long as one stands. A headline or deck that names an
    entity of events that were not chosen alone, or a number that no story has, is replaced."""
    none = F.array().cast("array<string>")
    sound = F.size("codes") == 0
    order = F.struct(section_order(F.col("section")), "seq")
    sections = judged_stories.groupBy("draft_id", "section").agg(F.count("*").alias("n"))
    cap = F.coalesce(F.element_at(tx.mapping(SECTION_CAPS), F.col("section")), F.lit(0))
    over = sections.groupBy("draft_id").agg(F.bool_or(F.col("n") > cap).alias("over"))
    held = F.array_sort(F.collect_list(F.when(sound, F.struct(order.alias("order"), "headline", "copy"))))  # a draft's stories
    by = judged_stories.groupBy("draft_id").agg(F.count("*").alias("raw"), F.count_if(sound).alias("stories"), held.alias("held"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("story_codes"))
    pool = events.groupBy("draft_id").agg(F.count_distinct("event_id").alias("events"))
    # Entities of events that were not chosen, less those of events that were, and whether the edition's own copy names one.
    chosen = judged_stories.where(sound).select("draft_id", "event_id").distinct()
    names = lambda df: df.select("draft_id", F.explode("entities").alias("entity")).distinct()
    strange = names(events.join(chosen, ["draft_id", "event_id"], "left_anti")).join(names(events.join(chosen, ["draft_id", "event_id"], "left_semi")), ["draft_id", "entity"], "left_anti")
    own = F.concat_ws(" ", "headline", "deck")
    named = drafts.select("draft_id", tx.grounded(own).alias("own")).join(strange, "draft_id").where((tx.grounded(F.col("entity")) != "") & F.contains("own", tx.grounded(F.col("entity")))).select("draft_id").distinct().withColumn("named", F.lit(True))
    out = drafts.join(by, "draft_id", "left").join(over, "draft_id", "left").join(pool, "draft_id", "left").join(named, "draft_id", "left")
    out = out.withColumns({"raw": F.coalesce("raw", F.lit(0)), "stories": F.coalesce("stories", F.lit(0)), "events": F.coalesce("events", F.lit(0)), "story_codes": F.coalesce("story_codes", none)})
    texts = F.coalesce(F.transform("held", lambda x: x["copy"]), none)
    foreign = F.size(F.array_except(tx.numbers(own), tx.numbers(F.array_join(texts, " ")))) > 0
    replaced = F.coalesce("named", F.lit(False)) | foreign
    out = out.withColumn("replaced", replaced)
    out = out.withColumns({"headline": F.when(F.col("replaced"), F.coalesce(F.get("held", F.lit(0))["headline"], F.lit(PLAIN_HEADLINE))).otherwise(F.col("headline")), "deck": F.when(F.col("replaced"), PLAIN_DECK).otherwise(F.col("deck"))})
    out = out.withColumn("words", words_in(F.col("kicker"), F.col("headline"), F.col("deck"), F.array_join(texts, " ")))
    flawed = F.size("story_codes") > 0
    codes = tx.codes(
        (F.col("over"), "SECTION_CAP_EXCEEDED"),
        (F.col("raw") > MOST_STORIES, "TOTAL_STORY_CAP_EXCEEDED"),
        ((F.col("events") >= STORY_FLOOR) & (F.col("stories") < STORY_FLOOR) & ~(F.col("repaired") & flawed), "STORY_FLOOR_NOT_MET"),
        (F.col("quiet") & (F.col("raw") > 0), "QUIET_DAY_HAS_STORIES"),
        (~F.col("quiet") & (F.col("stories") == 0), "NON_QUIET_DAY_HAS_NO_STORIES"),
        (F.col("words") > MOST_WORDS, "WORD_CAP_EXCEEDED"),
        (F.concat_ws(" ", "kicker", "headline", "deck").rlike(BANNED), "BANNED_EDITION_COPY"),
    )
    out = out.withColumn("codes", codes)
    blocked = flawed & (~F.col("repaired") | (F.col("stories") == 0))
    return out.withColumn("accepted", (F.size("codes") == 0) & ~blocked).drop("held", "over", "named", "raw", "events")


def section_order(section: Column) -> Column:
    return F.coalesce(F.element_at(tx.mapping({s: k for k, s in enumerate(SECTIONS)}), section.cast("string")), F.lit(len(SECTIONS)))


def ranked_in_section(stories: DataFrame, seq: str, section: str = "section") -> DataFrame:  # W7
    return stories.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(seq)))


def running_index(stories: DataFrame, section: str = "section", rank: str = "rank") -> DataFrame:  # W8
    """A number through all sections in their order: the counts of the sections before, plus the rank."""
    sizes = stories.groupBy(section).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(section_order(F.col(section)), section).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stories.join(before.drop("_n"), section).withColumn("running", F.col("_before") + F.col(rank)).drop("_before")


def citations(stories: DataFrame, facts: DataFrame) -> DataFrame:  # J10
    """(story_id, source_id, fact_ids, url) from a story's facts; `code` where a source has not exactly one URL."""
    used = stories.select("story_id", F.explode("fact_ids").alias("fact_id")).join(facts, "fact_id")
    by = used.groupBy("story_id", "source_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"), F.array_sort(F.collect_set("source_url")).alias("urls"))
    return by.select("story_id", "source_id", "fact_ids", F.get("urls", F.lit(0)).alias("url"), F.when(F.size("urls") != 1, "CITATION_URL_AMBIGUOUS_OR_MISSING").alias("code"))


def edition(draft: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:  # F31
    """Stories of a checked draft (story_id, event_id, section, seq, headline, dek, fact_ids) with rank, amount label, word
    count and citations; stories without their event are left out."""
    joined = draft.join(events.select("event_id", "company", "currency", "total_commitment", "initial_funding"), "event_id")
    joined = ranked_in_section(joined, "seq").withColumn("amount", tx.amount_label(F.col("currency"), F.col("total_commitment"), F.col("initial_funding"))).withColumn("words", words_in(F.col("headline"), F.col("dek")))
    cited = citations(draft, facts).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "url", "fact_ids"))).alias("citations"))
    return joined.join(cited, "story_id", "left")


def grouped(stories: DataFrame, sections: DataFrame) -> DataFrame:  # A20
    """The fixed sections in order with their stories; sections without stories stay, stories of unknown sections do not."""
    return sections.join(stories, "section", "left").groupBy("section", "section_no").agg(F.count("story_id").alias("n"), F.array_sort(F.collect_list("story_id")).alias("stories"))


def logo_domain(explicit: Column, *lookups: Column) -> Column:  # J12
    return F.coalesce(tx.blank_to_null(explicit), *(tx.blank_to_null(c) for c in lookups))

"""Keyed, idempotent sinks: cells, envelopes, snapshots, outbox, rendered text."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as tx
from tidewell.operators import keys


def cell(c: Column, kind: T.DataType) -> Column:  # SK6
    """Text of a value: null as nothing, booleans in capitals, instants in UTC, nested values as JSON, and a quote before
    text that a spreadsheet would take for a formula."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif isinstance(kind, T.MapType):
        text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    elif isinstance(kind, T.StructType):
        text = F.to_json(F.struct(*(c[n].alias(n) for n in sorted(kind.names))), {"ignoreNullFields": "false"})
    elif isinstance(kind, T.ArrayType):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "").when(text.rlike(r"^\s*[=+\-@]") & F.lit(isinstance(kind, T.StringType)), F.concat(F.lit("'"), text)).otherwise(text)


def cells(df: DataFrame) -> DataFrame:
    return df.select(*(cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def envelope(text: str | None, most: int = 45_000) -> str | None:  # SK7
    """Longer texts packed, with the hash of what they hold."""
    if text is None or len(text.encode()) <= most:
        return text
    packed = base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
    return f"gzip:{hashlib.sha256(text.encode()).hexdigest()}:{packed}"


def opened(cell_text: str | None, most: int = 1_000_000) -> str | None:
    if cell_text is None or not cell_text.startswith("gzip:"):
        return cell_text
    _, digest, packed = cell_text.split(":", 2)
    with gzip.GzipFile(fileobj=io.BytesIO(base64.b64decode(packed))) as f:
        raw = f.read(most + 1)
    if len(raw) > most or hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("envelope does not hold what it says")
    return raw.decode()


envelope_udf = F.pandas_udf(lambda s: s.map(envelope), T.StringType())
opened_udf = F.pandas_udf(lambda s: s.map(opened), T.StringType())


def write_snapshot(target: DataFrame, source: DataFrame, key: list[str], path: str) -> DataFrame:  # SK1
    """The merged table in a new folder; the folder that is read stays as it is."""
    keys.merge(target, source, key).write.mode("errorifexists").parquet(path)
    return source.sparkSession.read.parquet(path)


def raw_event_rows(events: DataFrame, candidates: DataFrame, test: bool) -> DataFrame:  # SK2, J7
    """Kept events with their candidate, flat, as rows of the table of events."""
    joined = events.where("decision = 'KEEP'").join(candidates, "candidate_id")
    return joined.withColumn("status", F.lit("TEST_ONLY" if test else "ELIGIBLE")).withColumn("notes", F.to_json(F.struct(F.col("facts").alias("verified_facts")))).drop("facts")


def story_rows(stories: DataFrame) -> DataFrame:  # SK4
    first = F.get("citations", F.lit(0))
    return stories.withColumn("canonical_url", first["url"]).withColumn("publisher", first["source_id"]).withColumn("published_story_id", F.concat_ws(":", "run_id", "event_id", "section", "rank"))


def digest_rows(runs: DataFrame) -> DataFrame:  # SK5
    """Runs as rows of their table: counts by section as JSON with sorted keys, the edition packed where it is long."""
    counts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("section_counts"))))
    return runs.withColumns({"section_counts": F.coalesce(counts, F.lit("{}")), "edition_json": envelope_udf("edition_json")})


def write_previews(bodies: DataFrame, path: str) -> None:  # SK10
    """Writes each body (name, body) to a folder of its name."""
    bodies.select("name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def outbox(existing: DataFrame, sends: DataFrame) -> DataFrame:  # SK8, ST9
    """Sends whose id is not there yet; the status says whether they may go out."""
    held = F.when(F.col("test_mode"), "HELD_TEST_MODE").when(~F.col("send_enabled"), "HELD_ENV_SEND_DISABLED").when(F.col("recipients") == 0, "HELD_NO_RECIPIENTS").when(F.col("recipients") > 49, "HELD_RECIPIENT_ERRORS").otherwise("READY_TO_SEND")
    return sends.withColumn("status", held).join(existing.select("send_id"), "send_id", "left_anti")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(stories: DataFrame, markup: bool = False) -> DataFrame:  # SK9, SK10
    """One text of all stories (section_no, section, rank, running, headline, url) in order; links only to https."""
    text = escape_html(F.col("headline")) if markup else F.col("headline")
    link = F.when(F.startswith("url", F.lit("https://")), F.col("url")).otherwise("")
    line = F.format_string("<li><a href=\"%s\">%s</a></li>" if markup else "%s\t%s", link, text) if markup else F.concat_ws(". ", F.col("running").cast("string"), F.trim(F.concat_ws(" ", text, link)))
    return stories.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))


# The sections of an edition in order with their labels, and what a rendered edition says around its stories.
LABELS = {"lead": "TOP STORY", "deal_tape": "VENTURE DEBT", "competitive_field": "BANKS + DEPOSITS", "ai_radar": "AI INTELLIGENCE", "runway_watch": "VENTURE CAPITAL"}
COMMENTARY, QUIET_GLANCE, QUIET, TEST_BANNER, TEST_PREFIX = "ANALYST COMMENTARY", "No stories today.", "No material stories today.", "TEST RENDER \u00b7 EMAIL DELIVERY DISABLED", "[TEST] "


def rendered_editions(editions: DataFrame, stories: DataFrame) -> DataFrame:  # SK9, SK10, W8
    """editions (run_id, headline, deck, edition_date, test) with subject, text and html of each, from its stories (run_id, section, rank, headline, dek,
    why_it_matters, citations: array of (publisher, url)): the headlines at a glance, then the sections that have stories, in their order; stories of
    unknown sections lead. Only https links without credentials are shown. An edition without stories says so."""
    section = F.when(F.col("section").isin(*LABELS), F.col("section")).otherwise("lead")
    number = F.element_at(tx.mapping({x: k for k, x in enumerate(LABELS)}), section)
    story = F.struct(number.alias("section_no"), F.col("rank").alias("rank"), *(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("headline", "dek", "why_it_matters")), "citations")
    out = editions.join(stories.groupBy("run_id").agg(F.array_sort(F.collect_list(story)).alias("stories")), "run_id", "left")  # an edition's stories
    empty = F.array().cast(out.schema["stories"].dataType)
    out = out.withColumn("stories", F.coalesce("stories", empty)).withColumn("label", F.concat(F.size("stories").cast("string"), F.when(F.size("stories") == 1, " STORY").otherwise(" STORIES")))
    held, quiet = F.col("stories"), F.size("stories") == 0
    safe = lambda c: F.filter(F.coalesce(c, F.array().cast("array<struct<publisher:string,url:string>>")), lambda x: F.coalesce(x["url"].rlike(r"^https://[^\s/?#@]+([/?#]\S*)?$"), F.lit(False)))
    name = lambda x: F.coalesce(tx.blank_to_null(x["publisher"]), F.lit("Source"))
    line = lambda *x: F.concat_ws("\n", *(F.lit(y) if isinstance(y, str) else y for y in x))
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))

    def told(x: Column) -> Column:
        cited = safe(x["citations"])
        sources = F.when(F.size(cited) > 0, F.concat(F.lit("Sources: "), F.array_join(F.transform(cited, lambda c: F.concat_ws(": ", name(c), c["url"])), " | ")))
        return line("", x["headline"], x["dek"], "", COMMENTARY, x["why_it_matters"], sources)

    def marked(x: Column) -> Column:
        links = F.transform(safe(x["citations"]), lambda c: F.concat(F.lit('<li><a href="'), escape_html(c["url"]), F.lit('">'), escape_html(name(c)), F.lit("</a></li>")))
        return F.concat(F.lit("<article>"), tag("h3", escape_html(x["headline"])), tag("p", escape_html(x["dek"])), tag("h4", F.lit(COMMENTARY)), tag("p", escape_html(x["why_it_matters"])), F.when(F.size(links) > 0, tag("ul", F.array_join(links, ""))).otherwise(""), F.lit("</article>"))

    def sections(each, before: str, after: str, between: str) -> Column:
        parts = []
        for k, label in enumerate(LABELS.values()):
            own = F.filter(held, lambda x: x["section_no"] == F.lit(k))  # noqa: B023
            parts.append(F.when(F.size(own) > 0, F.concat(F.lit(before + (label if not before else label.replace("&", "&amp;")) + after), F.array_join(F.transform(own, each), between))))
        return F.array(*parts)

    glance = F.when(quiet, QUIET_GLANCE).otherwise(F.array_join(F.transform(held, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["headline"])), "\n"))
    text = F.concat_ws("\n\n", F.when(F.col("test"), TEST_BANNER), F.concat_ws("\n", "headline", tx.blank_to_null(F.col("deck")), "edition_date"), F.concat_ws("\n", "label", glance), F.when(quiet, QUIET).otherwise(F.array_join(sections(told, "", "\n", "\n"), "\n\n")))
    body = F.when(quiet, tag("p", F.lit(QUIET))).otherwise(F.array_join(sections(marked, "<section><h2>", "</h2>", ""), "</section>"))
    listed = F.when(quiet, tag("p", F.lit(QUIET_GLANCE))).otherwise(tag("ol", F.array_join(F.transform(held, lambda x: tag("li", escape_html(x["headline"]))), "")))
    html = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body>'), F.when(F.col("test"), tag("p", F.lit(TEST_BANNER))).otherwise(""), tag("h1", escape_html(F.col("headline"))), tag("p", escape_html(F.coalesce("deck", F.lit("")))), tag("time", escape_html(F.coalesce("edition_date", F.lit("")))), tag("p", F.col("label")), listed, body, F.when(quiet, "").otherwise("</section>"), F.lit("</body></html>"))
    return out.select("run_id", F.concat(F.when(F.col("test"), TEST_PREFIX).otherwise(""), "headline").alias("subject"), text.alias("text"), html.alias("html"))

"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's expression gives a Boolean trigram query. One pass over the texts posts the document ids of every trigram
that some query names, in segments of a bounded number of documents; segment by segment the postings are intersected
and united as the queries say. Few trigrams cover all ways to satisfy a query; texts with none of them satisfy no query and
are posted nowhere, so the others are only looked for in the rest. Only the documents so found are verified against the
rule's expression, where their texts are read: the found ids go to all executors while they are few, and beyond that each text answers
the queries again, so that no text is ever moved. Rules without mandatory trigrams (plain hex runs) scan every text.

A null text counts as empty. Documents whose id is null cannot be posted and are scanned fully. Repeated rows each get
their row; a repeated id is verified in all its rows. Empty tables give no rows. Spans are code points, end exclusive.
Columns of any name are left alone.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.trigrams import ANY, query_of

#: Documents in a segment of the index.
SEGMENT = 4096
#: Candidates up to which they are sent to all executors: 16 bytes each, some 3 MB.
SMALL = 200_000
#: Matches whose places are added up at a time.
RUN = 128
SPANS = "array<struct<start:int,nth:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """pattern finds leftmost, non-overlapping matches; those with fewer than `least` characters in `group` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds, in the order in which their spans are listed.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are matched whole, so shorter ones need no match that is then dropped
)
#: Well-known token shapes beyond the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


def cover(rules: tuple[Rule, ...]) -> list[str]:
    """Few trigrams of which every way to satisfy a rule's query names one: each time the one that most of the others name."""
    open_ = [s for r in rules for s in query_of(r.pattern) if s]
    out = []
    while open_:
        out.append(max(sorted({t for s in open_ for t in s}), key=lambda t: sum(t in s for s in open_)))
        open_ = [s for s in open_ if out[-1] not in s]
    return out


def answers(text: Column, rule: Rule) -> Column:
    """Whether a text satisfies the rule's trigram query."""
    low = F.lower(text)
    ways = (functools.reduce(operator.and_, (F.contains(low, F.lit(t)) for t in sorted(s))) for s in query_of(rule.pattern))
    return functools.reduce(operator.or_, ways)


def index(docs: DataFrame, rules: tuple[Rule, ...], segments: int) -> DataFrame:
    """segment, postings: for each segment a map from trigram to the ids of the documents whose lowered text holds it."""
    named = sorted({t for r in rules for s in query_of(r.pattern) for t in s})
    low = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower("text").alias("low"))
    holds = lambda t: F.contains("low", F.lit(t))
    covered = functools.reduce(operator.or_, (holds(t) for t in cover(rules)), F.lit(False))
    low = low.where(covered)
    held = low.select("doc_id", F.array_compact(F.array(*(F.when(holds(t), F.lit(t)) for t in named)).cast("array<string>")).alias("held"))
    posted = held.select("doc_id", F.explode("held").alias("trigram"))
    lists = posted.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(segments)).alias("segment"), "trigram").agg(F.collect_set("doc_id").alias("ids"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, rules: the rules whose trigram query the document satisfies."""
    none = F.array().cast("array<bigint>")

    def satisfied(rule: Rule) -> Column:
        ways = []
        for trigrams in query_of(rule.pattern):
            lists = [F.coalesce(F.try_element_at("postings", F.lit(t)), none) for t in sorted(trigrams)]
            ids = lists[0]
            for more in lists[1:]:
                ids = F.array_intersect(ids, more)
            ways.append(ids)
        return F.array_distinct(F.flatten(F.array(*ways)))

    indexed = [r for r in rules if ANY[0] not in query_of(r.pattern)]
    by_rule = postings.select(F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), satisfied(r).alias("ids")) for r in indexed))).alias("x"))
    return by_rule.select("x.kind", F.explode("x.ids").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _within(run: Column, kind: str, order: int, least: int) -> Column:
    """Struct of the length of a run of matches with what precedes each, and its spans from its start."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["between"]
        span = F.struct(start.alias("start"), F.lit(order).alias("nth"), (start + x["length"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + x["length"]).alias("at"), F.when(x["judged"] >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).cast(SPANS).alias("spans"))

    return F.aggregate(run, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), step)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,nth,end,kind>>: the pieces between the matches and the matches themselves add up to the places,
    run by run, and the runs' lengths to where each run starts."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    lengths = F.transform(found, lambda x: F.length(x))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else lengths
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(lengths)).alias("between"), lengths.alias("length"), judged.alias("judged"))
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, F.lit(RUN)))
    runs = F.transform(cut(zipped), lambda run: _within(run, rule.kind, order, rule.least))
    starts = F.aggregate(runs, F.array(F.lit(0)), lambda at, run: F.concat(at, F.array(F.element_at(at, -1) + run["at"])))

    def moved(run: Column, at: Column) -> Column:
        return F.transform(run["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["nth"].alias("nth"), (s["end"] + at).alias("end"), s["kind"].alias("kind")))

    placed = F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), moved))
    return F.when(F.size(lengths) <= RUN, _within(zipped, rule.kind, order, rule.least)["spans"]).otherwise(placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text (null: empty), row (a struct of all columns as they were), and spans: all matches by start, then rule order."""
    whole = common.texts(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "row")
    ids = whole.select("doc_id", "text")
    segments = max(1, -(-docs.count() // SEGMENT))
    found, n = common.stored_rows(candidates(index(ids, rules, segments), rules), "secret-candidates")
    few = n <= SMALL
    joined = whole.join(F.broadcast(found), "doc_id", "left") if few else whole
    none = F.array().cast(SPANS)
    columns = []
    for k, rule in enumerate(rules):
        if ANY[0] in query_of(rule.pattern):
            asked = F.col("text").rlike(rule.pattern)
        elif few:
            asked = F.col("doc_id").isNull() | F.array_contains("rules", rule.kind)
        else:
            asked = F.col("doc_id").isNull() | answers(F.col("text"), rule)
        columns.append(F.when(F.coalesce(asked, F.lit(False)), spans_of(F.col("text"), rule, k)).otherwise(none))
    return joined.select("doc_id", "text", "row", F.array_sort(F.concat(*columns)).alias("spans"))


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by [SECRET:kind], n_chars counted anew where a text changed. Spans that
    overlap an earlier one are replaced with it. Rows without spans stay as they are, null texts too."""
    found = scan(docs, rules)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("[SECRET:"), s["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["parts"], F.array(gap, mark))).otherwise(state["parts"]).alias("parts"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    hit = F.size("spans") > 0
    changed = found.select("row", hit.alias("hit"), F.when(hit, clean).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    of = lambda c: F.col("row").getField(c)
    return changed.select(*((F.when(F.col("hit"), new[c]).otherwise(of(c)) if c in new else of(c)).alias(c) for c in docs.columns))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["nth"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


def sql_spans(source: str, rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB CTEs from `source` (columns n, a row number, and text) to `spans`: n and the list of spans in order."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ctes = []
    for k, r in enumerate(rules):
        ctes.append(f"""m{k} as (select n, regexp_extract_all(text, {quoted(r.pattern)}, 0) as found, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) as judged, string_split_regex(text, {quoted(r.pattern)}) as pieces from {source}),
p{k} as (select n, unnest(list_transform(range(1, len(found) + 1), lambda i: {{'start': cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) as bigint), 'size': length(found[i]), 'judged': length(judged[i])}})) as s from m{k} where len(found) > 0)""")
    rows = " union all ".join(f"select n, s.start as a, s.start + s.size as b, {k} as nth, '{r.kind}' as kind from p{k} where s.judged >= {r.least}" for k, r in enumerate(rules))
    return ",\n".join(ctes) + f",\nspans as ({rows})"


OP3_SQL = f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
{sql_spans("d")},
g as (select n, {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || a || ':' || b, ',' order by a, nth) filter (where nth < {len(BASE)}) as base,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, nth) as spans from spans group by n)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (n)
"""

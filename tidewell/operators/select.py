"""Choosing candidates: order, keyword scores, seeds, quotas and the balanced round robin."""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx

LANE_ORDER = ("venture_debt", "competitor_deposit", "ai")


def keyword_score(text: Column, weights: dict[str, int]) -> Column:  # A12
    """Sum of the weights of the patterns that occur."""
    total = F.lit(0)
    for pattern, weight in weights.items():
        total = total + F.when(text.rlike(pattern), weight).otherwise(0)
    return total


# Phrases that make a financing announcement concrete, and how much; a named amount counts 3.
SIGNALS = {"venture debt": 8, "growth debt": 8, "senior secured": 7, "credit facility": 7, "financing facility": 7, "term loan": 6, "debt financing": 6, "asset-backed": 5, "asset backed": 5, "refinancing": 4}
NAMED_AMOUNT = r"(?i)\b[$€£]\s?\d|\b\d+(?:\.\d+)?\s?(?:m|mm|bn|million|billion)\b"


def priority_signal(section: Column, title: Column, summary: Column) -> Column:  # A12
    """Score of a candidate of the deal section by the phrases in title and summary; 0 in other sections."""
    text = F.lower(F.concat_ws(" ", title, summary))
    total = F.when(text.rlike(NAMED_AMOUNT), 3).otherwise(0)
    for phrase, weight in SIGNALS.items():
        total = total + F.when(F.contains(text, F.lit(phrase)), weight).otherwise(0)
    return F.when(section == "deal_tape", total).otherwise(0)


def priority_rank(c: Column) -> Column:
    return F.when(c == "P0", 0).when(c == "P1", 1).when(c == "P2", 2).otherwise(9)


def candidate_order(hits: str, primary: str, priority: str, signal: str, published: str, key: str) -> list[Column]:  # T2
    """Watched first, then primary sources, priority, signal, recency (none: oldest), id ascending."""
    return [F.desc(F.size(hits) > 0), F.desc(primary), priority_rank(F.col(priority)).asc(), F.desc(signal), F.desc(F.coalesce(F.unix_micros(F.col(published).cast("timestamp")), F.lit(0))), F.asc(key)]


def candidate_place(hits: str, primary: str, priority: str, signal: str, published: str, key: str) -> Column:  # T2
    """The same order as one value, the first row's being the least."""
    late = F.coalesce(F.unix_micros(F.col(published).cast("timestamp")), F.lit(0))
    return F.struct((F.size(hits) <= 0).alias("unwatched"), (~F.coalesce(F.col(primary), F.lit(False))).alias("secondary"), priority_rank(F.col(priority)).alias("priority"), (-F.col(signal)).alias("signal"), (-late).alias("late"), F.col(key).alias("key"))


def seeds(df: DataFrame, discovery: str, relevance: str, published: str, key: str, title: str, limit: int) -> DataFrame:  # T3
    """Discovery rows first, then the rest, by relevance, recency and id; one row a normalised title."""
    order = [F.desc(discovery), F.desc(relevance), F.desc_nulls_last(published), F.desc(key)]
    named = df.withColumn("_t", F.trim(tx.padded_words(F.col(title))))
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(*order))).where("_n = 1").drop("_n", "_t")
    return once.orderBy(*order).limit(limit)


def capped(df: DataFrame, key: str, seq: str, most: int) -> DataFrame:  # T5
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where(F.col("_n") <= most).drop("_n")


def budgeted(df: DataFrame, key: str, seq: str, wants: Column, budget: int) -> DataFrame:  # W12
    """Adds `looked_up`: whether the row asks for a lookup and is among the first `budget` of its key that do."""
    run = F.sum(wants.cast("int")).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("looked_up", wants & (run <= budget))


def round_robin(df: DataFrame, most: int, per_source: int, lane: str = "lane", source: str = "source_id", pos: str = "pos") -> DataFrame:  # W11
    """The first `most` rows as lanes take turns, where URLs and contents are unique. A source has one share of rows, its first by `pos`, for
    all lanes together; first rows come before second ones, and within a lane sources by their first rows."""
    lane_no = F.element_at(tx.mapping({x: k for k, x in enumerate(LANE_ORDER)}), F.col(lane))
    pool = df.withColumn("_depth", F.row_number().over(Window.partitionBy(source).orderBy(pos))).where(F.col("_depth") <= per_source)
    pool = pool.withColumn("_first", F.min(pos).over(Window.partitionBy(lane, source)))
    pool = pool.withColumn("_turn", F.row_number().over(Window.partitionBy(lane, "_depth").orderBy("_first")))
    return pool.orderBy("_depth", "_turn", lane_no).limit(most).select(df.columns)


@dataclass(frozen=True)
class Pass:
    """A pass of the selection: which rows it looks at, up to how many in all are chosen (`most`), no more than `more` by this pass, and how
    many rows of a source there may be then."""

    pool: Column
    most: int
    more: int | None = None
    per_source: int = 1


#: Rows of a lane that a round offers, and of a source in a lane at first; neither bounds what can be chosen.
OFFER, DEEP = 256, 16


@dataclass
class _State:
    """Where a pass stands: the depth, whose turn it is, and whether this rotation has chosen a row."""

    depth: int = 0
    turn: int = 0
    moved: bool = False


class Selection:
    """Rows chosen so far. Each is new by URL, content and key, the third of no job, and of its source no more than the pass allows."""

    def __init__(self, per_job: int):
        self.per_job = per_job
        self.rows: list[tuple] = []  # key, pass number
        self.urls: set[str] = set()
        self.hashes: set[str] = set()
        self.jobs: Counter[str] = Counter()
        self.sources: Counter[str] = Counter()

    def add(self, r: Row, number: int, per_source: int) -> bool:
        if r["url"] in self.urls or r["hash"] in self.hashes or self.jobs[r["job"]] >= self.per_job or self.sources[r["source"]] >= per_source:
            return False
        self.rows.append((r["key"], number))
        self.urls.add(r["url"])
        self.hashes.add(r["hash"])
        self.jobs[r["job"]] += 1
        self.sources[r["source"]] += 1
        return True

    def open(self, per_source: int) -> Column:
        """Which rows nothing speaks against so far."""
        among = lambda c, values: F.col(c).isin(sorted(values)) if values else F.lit(False)
        full = [j for j, n in self.jobs.items() if n >= self.per_job]
        spent = [x for x, n in self.sources.items() if n >= per_source]
        return ~(among("url", self.urls) | among("hash", self.hashes) | among("job", full) | among("source", spent))


def _rotate(offered: dict[str, deque], whole: dict[str, bool], deep: int, at: _State, selection: Selection, number: int, step: Pass, target: int) -> str:
    """Go on as far as the offered rows tell what comes next: `done`, or what has to be offered: `more` rows, or `deeper` ones."""
    while len(selection.rows) < target:
        lane = LANE_ORDER[at.turn]
        queue = offered[lane]
        while queue and queue[0]["depth"] < at.depth:
            queue.popleft()
        picked = False
        while queue and queue[0]["depth"] == at.depth < deep and not picked:
            picked = selection.add(queue.popleft(), number, step.per_source)
        if not picked:
            if queue and queue[0]["depth"] == at.depth == deep:
                return "deeper"
            if not queue and not whole[lane]:
                return "more"
        at.moved |= picked
        at.turn += 1
        if at.turn == len(LANE_ORDER):
            at.turn = 0
            if not at.moved:
                waiting = [q[0]["depth"] for q in offered.values() if q]
                if not waiting:
                    return "done"
                at.depth = min(waiting)
            at.moved = False
    return "done"


def balanced(df: DataFrame, passes: list[Pass], place: Column, key: str, url: str, content: str, job: str, source: str = "source_id", lane: str = "lane", per_job: int = 2, offer: int = OFFER, deep: int = DEEP) -> DataFrame:  # W11
    """The rows that the passes choose, with `pass_no` and `place`, the number of the row among all chosen.

    Lanes take turns; within a lane each source offers its first row by `place` (which no two rows share) before any offers a second, and sources come by their first
    rows. A row that repeats a chosen URL or content, or whose job or source has its share, is passed over, and the lane offers the next.
    What a row is rejected for stays, so a pass goes in rounds: a query ranks the pool, drops all rows that something speaks against, and
    brings the next `offer` rows of each lane; the rotation, which goes from row to row by its nature, uses them up. Rounds end when
    the target is reached or nothing is left; each chooses a row or ends its pass, and a pass seldom takes two. The driver holds the offered
    and the chosen rows alone; the pool is ranked where it lies, and of a source no deeper than rounds have come."""
    fields = {"key": key, "url": url, "hash": content, "job": job, "source": source, "lane": lane}
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    selection, shape = Selection(per_job), f"`{key}` {df.schema[key].dataType.simpleString()}, pass_no int, place int"
    for number, step in enumerate(passes):
        target = min(step.most, len(selection.rows) + (step.most if step.more is None else step.more))
        named = [F.col(v).alias(k) if k == "key" else blank(v).alias(k) for k, v in fields.items()]
        pool = df.where(step.pool).select(*named, place.alias("at"))
        at, depth = _State(), deep
        by_source = Window.partitionBy("lane", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        while len(selection.rows) < target:
            # The bound on the plain row number is one that Spark applies before the shuffle too, so that a large source stays where it lies.
            ranked = pool.withColumn("nth", F.row_number().over(by_source)).withColumn("first", F.first("at").over(by_source)).where(F.col("nth") <= depth + 1).withColumn("depth", F.col("nth") - 1)
            queue = Window.partitionBy("lane").orderBy("depth", "first")
            # The deepest row of a source tells that there may be more of it, whatever speaks against the row itself.
            left = ranked.where((F.col("depth") >= at.depth) & (selection.open(step.per_source) | (F.col("depth") == depth))).withColumn("nth", F.row_number().over(queue)).where(F.col("nth") <= offer)
            offered: dict[str, deque] = {x: deque() for x in LANE_ORDER}
            for r in sorted(left.select("key", "url", "hash", "job", "source", "lane", "depth", "nth").collect(), key=lambda r: r["nth"]):  # `offer` a lane at most
                offered[r["lane"]].append(r)
            whole = {x: len(q) < offer for x, q in offered.items()}
            said = _rotate(offered, whole, depth, at, selection, number, step, target)
            if said == "done":
                break
            depth = depth * 8 if said == "deeper" else depth
    chosen = [(k, number, place) for place, (k, number) in enumerate(selection.rows)]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(chosen, shape)), key)  # no more rows than the largest target

"""Hard-negative mining by norm-bucketed exact search over integer inner products.

Candidates are sorted by norm, longest first, and cut into buckets. By Cauchy-Schwarz no row of a bucket scores more with an
anchor than the anchor's norm times the largest norm of the bucket, so the buckets that an anchor needs are a first run of them:
those whose bound reaches the least score that any of its windows still takes, which is the window's lower limit, or the
running kth score once k rows lie in it. Buckets are searched in waves of growing width (1, 4, 16, ...); after each, the kth scores
of the windows rise and the runs get shorter. What is pruned is neither shuffled nor scored. In a cell (bucket, slot, batch of
anchors) scores are one matrix product; it gives the k best of each window and no more.

First the positives of an anchor (rows of its label, one window without limits), then for each different positive score the window of
other-label scores between `low` and `high` per cent of it. Windows of negative positives are empty, as low < high.

Equal rows are one: vectors of one label that are equal are one entry with its smallest ids, as many as any list can hold, and equal
anchors are searched once. So a vector that a third of the rows hold is one entry, and its anchors get copies of one result, spread
by a salt. Where all norms are equal, as with unit vectors, nothing but the windows' limits can prune, and each anchor is scored against
all rows, in blocks.

Edges: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; rows that repeat in id, label
and vector count once, and rows that share an id only are different rows; vectors of another length are no candidates; ties go to
the smaller id; scores beyond 64 bits are clamped; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import common

#: Entries of a slot, anchors of a batch, buckets at most (their norms are all that the driver sees).
BUCKET, BATCH, MOST_BUCKETS = 4096, 1024, 4096
#: Buckets of a wave: so many times those before it.
WIDER = 4
#: Copies of an anchor's result, over which the rows that are this anchor spread.
SPREAD = 16
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "name long, positive long, vec_id long, score long, own boolean"


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label and v, the components as floor(scale * x), of the rows that take part, each once."""
    x = lambda c: c.cast("double")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(x(c)) < float("inf")))
    held = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound)
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda c: F.floor(x(c) * scale).cast("long")).alias("v")).distinct()


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact in 64 bits; clamped beyond."""
    most = lambda x: max(int(x.max()), -int(x.min()))
    bound = most(a) * most(b) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return np.stack([b @ row for row in a])
    return np.array([[max(LEAST, min(MOST, sum(int(s) * int(t) for s, t in zip(x, y, strict=True)))) for y in b] for x in a], dtype=np.int64)


def best(score: np.ndarray, floor: np.ndarray, top: np.ndarray, ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, id and score of each row's k best between floor and top; ties go to the smaller id. A column stands for all of its ids."""
    inside = (score >= floor[:, None]) & (score <= top[:, None])
    if score.shape[1] > k:
        masked = np.where(inside, score, LEAST)
        inside &= score >= np.partition(masked, -k, axis=1)[:, -k, None]
    r, c = np.nonzero(inside)
    first = np.array([x[0] for x in ids], dtype=np.int64)
    cut = lambda r: np.arange(len(r)) - np.searchsorted(r, r) < k
    order = np.lexsort((first[c], -score[r, c], r))
    r, c = r[order], c[order]
    r, c = r[keep := cut(r)], c[keep]
    size = np.array([len(ids[x]) for x in c], dtype=np.int64)
    vec = np.array([i for x in c for i in ids[x]], dtype=np.int64)
    r, c = np.repeat(r, size), np.repeat(c, size)
    order = np.lexsort((vec, -score[r, c], r))
    r, c, vec = r[order], c[order], vec[order]
    r, c, vec = r[keep := cut(r)], c[keep], vec[keep]
    return r, c, vec, score[r, c]


def _cell(k: int, same: bool):
    """Anchors with their windows meet the entries of one slot of a bucket."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            matrix = lambda t: np.array(t.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(t.num_rows, -1)
            queries, entries = matrix(asked), matrix(held)
            names, of = (np.array(t.column("name")) for t in (asked, held))
            labels, kinds = (np.array(t.column("label")) for t in (asked, held))
            windows, ids = asked.column("windows").to_pylist(), held.column("ids").to_pylist()
            for label in np.unique(labels):
                mine, there = np.flatnonzero(labels == label), np.flatnonzero((kinds == label) == same)
                step = max(1, (1 << 21) // max(1, len(there)))
                for a in range(0, len(mine) if len(there) else 0, step):
                    q = mine[a : a + step]
                    score = scores(queries[q], entries[there])
                    for j in range(max(len(windows[x]) for x in q)):
                        open_ = np.array([n for n, x in enumerate(q) if len(windows[x]) > j])
                        w = [windows[q[n]][j] for n in open_]
                        r, c, vec, s = best(score[open_], np.array([x["floor"] for x in w]), np.array([x["top"] for x in w]), [ids[x] for x in there], k)
                        out.append([names[q[open_[r]]], np.array([x["positive"] for x in w], dtype=np.int64)[r], vec, s, names[q[open_[r]]] == of[there[c]]])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        return pa.table(dict(zip(("name", "positive", "vec_id", "score", "own"), columns, strict=True)))

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("name", "positive").orderBy(F.desc("score"), "vec_id", "own")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def reach(norm: Column, least: Column, norms: list[float]) -> Column:
    """How many of the buckets, largest norm first, have a bound that comes to `least`; doubles err by less than what is added."""
    return F.size(F.filter(F.array(*map(F.lit, norms)), lambda m: m * norm * (1 + 1e-9) + 1 >= least.cast("double")))


class Index:
    """Entries (name, label, v, norm, ids) in buckets by norm. depth: ids that an entry keeps."""

    def __init__(self, rows: DataFrame, depth: int, bucket: int = BUCKET, most: int = MOST_BUCKETS):
        nth = Window.partitionBy("label", "v").orderBy("vec_id")
        ids = rows.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= depth).groupBy("label", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        grouped, n = common.stored_rows(ids.withColumn("norm", norm), "entries")
        buckets = max(1, min(most, -(-n // bucket)))
        self.slots = max(1, -(-n // (buckets * bucket)))
        ranged = grouped.repartitionByRange(buckets, F.desc("norm"), F.xxhash64("v"))
        self.entries = common.stored(ranged.withColumn("bucket", F.spark_partition_id()).withColumn("name", F.monotonically_increasing_id()), "buckets")
        held = self.entries.groupBy("bucket").agg(F.max("norm").alias("norm"), F.min("norm").alias("least")).orderBy("bucket").collect()  # MOST_BUCKETS at most
        self.buckets, self.norms = [r["bucket"] for r in held], [r["norm"] for r in held]

    def search(self, asked: DataFrame, k: int, same: bool, batch: int = BATCH) -> DataFrame:
        """The k best rows of every window of `asked` (name, label, v, norm, windows: array of (positive, floor, top)), of the
        anchor's own label or of all others."""
        spark = asked.sparkSession
        asked, n = common.stored_rows(asked, "asked")
        batches = max(1, -(-n // batch))
        found = spark.createDataFrame([], FOUND)
        done, width = 0, 1
        while done < len(self.buckets) and n:
            upto = min(len(self.buckets), done + width)
            kth = found.groupBy("name", "positive").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            kth = kth.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("positive", "kth"))).alias("kth"))  # a window a different positive score
            raised = F.transform("windows", lambda w: F.struct(w["positive"].alias("positive"), F.greatest(w["floor"], F.coalesce(F.try_element_at("kth", w["positive"]), w["floor"])).alias("floor"), w["top"].alias("top")))
            now = asked.join(kth, "name", "left").withColumn("windows", raised).drop("kth")
            least = F.array_min(F.transform("windows", lambda w: w["floor"]))
            runs = reach(F.col("norm"), least, self.norms[:upto])
            now = now.withColumn("bucket", F.explode(F.slice(F.array(*map(F.lit, self.buckets[done:upto])), F.lit(1), F.greatest(F.lit(0), runs - done))))
            now = common.stored(now.withColumn("batch", F.pmod(F.xxhash64("name"), F.lit(batches)).cast("int")).withColumn("dim", F.size("v")), "asked")
            cells = now.select(*(F.col(c).alias(c) for c in ("dim", "bucket", "batch"))).distinct()
            slots = now.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(self.slots - 1))))
            held = self.entries.where(F.col("bucket").isin(self.buckets[done:upto])).withColumn("dim", F.size("v"))
            held = held.withColumn("slot", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(self.slots)).cast("int")).join(cells, ["dim", "bucket"])
            key = ("dim", "bucket", "slot", "batch")
            made = slots.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_cell(k, same), FOUND)
            found = common.stored(_top(found.unionByName(made), k), "found")
            done, width = upto, width * WIDER
        return found


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, bucket: int = BUCKET, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of `rows` (as quantised() gives them)
    that `anchors` holds for, and each of its first `positives` other rows of the same label, the first `negatives` rows of
    other labels that score between low and high per cent of the positive."""
    index = Index(rows, max(positives + 1, negatives), bucket)
    here = rows.where(anchors)
    asked = index.entries.join(here.select("label", "v").distinct(), ["label", "v"], "left_semi").select("name", "label", "v", "norm")
    window = lambda p, lo, hi: F.struct(p.cast("long").alias("positive"), lo.cast("long").alias("floor"), hi.cast("long").alias("top"))
    one = F.array(window(F.lit(0), F.lit(LEAST), F.lit(MOST)))
    same = index.search(asked.withColumn("windows", one), positives + 1, True, batch)
    near = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id", "score", "own")))
    near = common.stored(same.groupBy("name").agg(near.alias("near")), "near")  # positives + 1 each
    exact = lambda c, share: F.lit(Decimal(share).scaleb(-2)) * c.cast("decimal(20,0)")
    limits = F.transform(F.array_distinct(F.transform(F.filter("near", lambda x: x["score"] >= 0), lambda x: x["score"])), lambda p: window(p, F.ceil(exact(p, low)), F.floor(exact(p, high))))
    other = index.search(asked.join(near, "name").withColumn("windows", limits).drop("near").where(F.size("windows") > 0), negatives, False, batch)
    lists = other.groupBy("name", "positive").agg(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id", "score"))).alias("hard"))
    lists = lists.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("positive", "hard"))).alias("hard"))
    results = common.stored(asked.join(near, "name").join(lists, "name").select("label", "v", "near", "hard"), "results")
    spread = results.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    own = here.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int")).join(spread, ["label", "v", "salt"])
    first = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("vec_id")))), 1, positives)
    pairs = own.select(F.col("vec_id").alias("anchor_id"), "hard", F.explode(first).alias("p"))
    out = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.try_element_at("hard", F.col("p.score"))).alias("n", "x"))
    return out.select("anchor_id", "positive_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = quantised(common.table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(common.stored(rows, "vectors"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with d as (
  select distinct cast(vec_id as bigint) as vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else cast(label as bigint) end as label,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
r as (select row_number() over () as row_no, * from d),
s as (
  select a.row_no, a.vec_id as anchor_id, a.label = c.label as same, c.vec_id, cast(list_dot_product(cast(a.v as double[]), cast(c.v as double[])) as bigint) as score
  from r a join r c on a.row_no <> c.row_no and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by row_no order by score desc, vec_id) as n from s where same) where n <= 5),
h as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.row_no, p.n order by s.score desc, s.vec_id) as k
  from p join s on p.row_no = s.row_no and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(k as integer) as "rank", negative_id, positive_score, negative_score from h where k <= 10
"""

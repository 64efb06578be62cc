"""Near duplicates among embeddings by an inverted multi-index.

The two halves of a unit vector are quantised by codebooks of their own, learned by k-means on a bounded sample; a cell is a pair of
centroids, so that few centroids make a grid of very many cells. Every vector is posted in its own cell, and visits cells in order of its
distance to them, as the multi-sequence algorithm walks the sorted distances of both halves, until the target recall: its own cell is
the nearest, and it goes on until a cell is farther than the nearest by the excess within which `recall` of simulated neighbours,
pairs at just the threshold, have each other's cell. What meets in a cell is compared exactly. Pairs of one label only meet.

Both vectors of a pair may visit the other's cell. It counts in one of them, which either can tell from the other's list of visited cells:
the lower cell of the two, or in one cell the lower name. So links are counted without writing them down: a task gives a count
for each vector and the edges of a spanning forest, never all pairs of a group. Cells with more than BLOCK rows are dealt to blocks that meet
block by block.

Equal vectors of one label are one entry with a weight. Entries of more than a thousandth of all rows, of which there are a thousand at most,
meet their rows by broadcast.

Edges: vectors that are null, empty or zero, or hold null or non-finite components, and rows without a label or an id link with nothing; those
with an id are their own component; a row without an id has a null component and is not kept. Repeated rows are rows of their own, which link. Vectors
of another length link with nothing. Other columns are left out; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common, components

#: Rows of either side of a task, and of both sides together those that a batch of visits takes.
BLOCK = 2048


@dataclass(frozen=True)
class Limits:
    """threshold: least cosine of a link. recall: share of pairs at the threshold that have to meet. sample: vectors that the codebooks are learned from.
    per_cell: vectors that a cell should have. most: centroids of a codebook at most."""

    threshold: float = 0.98
    recall: float = 0.9999
    sample: int = 16_384
    per_cell: int = 128
    most: int = 256


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def halves(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves, cut or filled up with zeros to `width`."""
    cut = (v.shape[1] + 1) // 2
    out = []
    for x in (v[:, :cut], v[:, cut:]):
        held = np.zeros((len(v), width))
        held[:, : min(width, x.shape[1])] = x[:, :width]
        out.append(held)
    return out[0], out[1]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1))


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly drawn rows; a centroid without rows stays where it is."""
    book = x[np.linspace(0, len(x) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, book).argmin(axis=1)
        sums, n = np.zeros_like(book), np.bincount(near, minlength=size)
        np.add.at(sums, near, x)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves, and how much farther than the nearest cell a vector goes."""

    first: np.ndarray
    second: np.ndarray
    excess: float

    def sequences(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the centroids of both halves, nearest first, and how much farther than the nearest they are."""
        out = []
        for x, book in zip(halves(v, self.first.shape[1]), (self.first, self.second), strict=True):
            far = distances(x, book)
            order = far.argsort(axis=1, kind="stable")
            far = np.take_along_axis(far, order, axis=1)
            out += [order, far - far[:, :1]]
        return out[0], out[1], out[2], out[3]

    def visits(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of each visit, in order of a row's visits. In each step every row goes to the nearest cell that it has not seen: of each
        centroid of the first half, the next one of the second half waits, and the least sum of the two is taken."""
        one, far1, two, far2 = self.sequences(v)
        size = far2.shape[1]
        rows, place = np.arange(len(v)), np.zeros(far1.shape, dtype=np.int64)
        seen_rows, seen_cells = [], []
        waiting = far1 + far2[:, :1]
        while len(rows):
            k = waiting.argmin(axis=1)
            at = np.arange(len(rows))
            going = waiting[at, k] <= self.excess
            rows, place, waiting, k = rows[going], place[going], waiting[going], k[going]
            at = np.arange(len(rows))
            j = place[at, k]
            seen_rows.append(rows)
            seen_cells.append(one[rows, k] * size + two[rows, j])
            place[at, k] = j + 1
            waiting[at, k] = np.where(j + 1 < size, far1[rows, k] + far2[rows, np.minimum(j + 1, size - 1)], np.inf)
        r, c = np.concatenate(seen_rows), np.concatenate(seen_cells)
        order = np.argsort(r, kind="stable")
        return r[order], c[order]


def fitted(v: np.ndarray, n: int, limits: Limits) -> Index:
    """An index for n vectors, from the unit vectors of a sample."""
    size = max(1, min(limits.most, len(v), round((n / limits.per_cell) ** 0.5)))
    width = (v.shape[1] + 1) // 2
    one, two = halves(v, width)
    bare = Index(codebook(one, size), codebook(two, size), 0.0)
    rng = np.random.default_rng(7)
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(axis=1, keepdims=True) * v
    norm = np.sqrt((side * side).sum(axis=1, keepdims=True))
    near = limits.threshold * v + np.sqrt(max(0.0, 1 - limits.threshold**2)) * side / np.where(norm > 0, norm, 1)
    own, other = bare.sequences(v), bare.sequences(near)

    def farther(x, y):
        """How much farther than its nearest cell y's own cell is for x."""
        out = 0
        for order, far, nearest in ((x[0], x[1], y[0]), (x[2], x[3], y[2])):
            out = out + np.take_along_axis(far, np.argmax(order == nearest[:, :1], axis=1)[:, None], axis=1)[:, 0]
        return out

    excess = np.quantile(np.minimum(farther(own, other), farther(other, own)), limits.recall, method="higher") if len(v) else 0.0
    return Index(bare.first, bare.second, float(excess))


def _visit(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                size = np.array([len(x) for x in batch.column("v")])
                flat = np.array(batch.column("v").flatten(), dtype=np.float64)
                starts = np.cumsum(size) - size
                lists: list = [None] * len(size)
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    r, c = index.visits(unit(flat[starts[own][:, None] + np.arange(dim)]))
                    cuts = np.searchsorted(r, np.arange(len(own) + 1))
                    for k, at in enumerate(own):
                        lists[at] = c[cuts[k] : cuts[k + 1]]
                held = pa.array(lists, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, held], [*batch.schema.names, "cells"])

    return run


def compared(visitors: pa.Table, members: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name and weight of linked entries for both ends of the links of a cell, and edges that connect what they connect."""
    matrix = lambda t: unit(np.array(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1))
    u, w = (np.array(t.column("name")) for t in (visitors, members))
    nu, nw = (np.array(t.column("n")) for t in (visitors, members))
    home, cell = np.array(visitors.column("home")), members.column("home")[0].as_py()
    link = matrix(visitors) @ matrix(members).T >= threshold
    # Where a member visits the visitor's home as well, the pair counts in the lower of the two cells; within one cell, once.
    cells = members.column("cells").combine_chunks()
    flat, size = np.array(cells.flatten()), np.diff(np.array(cells.offsets))
    owner = np.repeat(np.arange(len(w)), size)
    for h in np.unique(home):
        rows = np.flatnonzero(home == h)
        if h == cell:
            link[rows] &= u[rows, None] < w
        elif h < cell:
            twice = np.zeros(len(w), dtype=bool)
            twice[owner[flat == h]] = True
            link[np.ix_(rows, twice)] = False
    x, y = np.nonzero(link)
    names, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    total = np.zeros(len(names), dtype=np.int64)
    np.add.at(total, at[: len(u)], link @ nw)
    np.add.at(total, at[len(u) :], nu @ link)
    a, b = components.contracted(u[x], w[y])
    return names[total > 0], total[total > 0], a, b


def _cell(threshold: float):
    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        if not visitors.num_rows or not members.num_rows:
            names, total, a, b = (np.zeros(0, np.int64) for _ in range(4))
        else:
            names, total, a, b = compared(visitors, members, threshold)
        zero = np.zeros(len(a), np.int64)
        return pa.table({"a": np.concatenate([names, a]), "b": np.concatenate([names, b]), "n": np.concatenate([total, zero])})

    return run


def _blocks(cells: DataFrame) -> DataFrame:
    """label, dim, cell, members, visitors: into how many blocks the rows of a cell go, of cells with more than BLOCK rows on a side."""
    n = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / BLOCK)).cast("int")
    counts = cells.groupBy("label", "dim", "cell").agg(n((F.col("cell") == F.col("home")).cast("int")).alias("members"), n(F.lit(1)).alias("visitors"))
    return counts.where("members > 1 or visitors > 1")


#: Cells of several blocks up to which they are broadcast.
SMALL = 1_000_000


def linked(entries: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """name, n (weight of the entries linked with it) and node, component of entries (name, label, n, v); both stored, only of those that have links."""
    spark = entries.sparkSession
    n = entries.count()
    none = spark.createDataFrame([], "node long, component long")
    if not n:
        return spark.createDataFrame([], "name long, n long"), none
    picked = common.bounded(entries).orderBy(F.xxhash64("v"), "name").limit(limits.sample).select("v").collect()  # bounded by `sample`
    widest = max((len(r["v"]) for r in picked), default=1)
    sample = np.zeros((len(picked), widest))
    for k, r in enumerate(picked):
        held = unit(np.array([r["v"]], dtype=np.float64))[0]
        cut = (len(held) + 1) // 2
        sample[k, :cut], sample[k, (widest + 1) // 2 : (widest + 1) // 2 + len(held) - cut] = held[:cut], held[cut:]
    index = fitted(sample, n, limits)
    shape = "name long, label long, n long, v array<float>, cells array<long>"
    posted = entries.select("name", "label", "n", "v").mapInArrow(_visit(index), shape)
    posted = posted.withColumn("home", F.get("cells", F.lit(0))).withColumn("dim", F.size("v"))
    posted = common.stored(posted, "posted")
    visits = posted.withColumn("cell", F.explode("cells"))
    hot, many = common.stored_rows(_blocks(visits.select("label", "dim", "cell", "home")), "hot")
    hot = F.broadcast(hot) if many <= SMALL else hot
    block = lambda c, other: [F.pmod(F.xxhash64("name"), F.coalesce(c, F.lit(1))).cast("int"), F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)]

    def dealt(df: DataFrame, own: str, other: str, *more: str) -> DataFrame:
        key, every = block(F.col(own), other)
        return df.join(hot, ["label", "dim", "cell"], "left").select(key.alias(f"{own}_block"), F.explode(every).alias(f"{other}_block"), *(F.col(c).alias(c) for c in ("label", "dim", "cell", "name", "n", "v", "home", *more)))

    key = ("label", "dim", "cell", "members_block", "visitors_block")
    left = dealt(visits, "visitors", "members").groupBy(*key)
    right = dealt(posted.withColumn("cell", F.col("home")), "members", "visitors", "cells").groupBy(*key)
    made = common.stored(left.cogroup(right).applyInArrow(_cell(limits.threshold), "a long, b long, n long"), "links")
    counts = made.where("n > 0").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
    edges = made.where("n = 0").select("a", "b")
    return counts, components.components(edges) if edges.limit(1).count() else none


def near_duplicates(vectors: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound, F.lit(False))
    rows = common.bounded(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(takes_part, F.col("label").cast("long")).alias("label"), F.when(takes_part, F.col("embedding").cast("array<float>")).alias("v"))
    grouped, total = common.stored_rows(rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "grouped")
    # Unique names that are hashes as well: this hash of eight bytes is one to one.
    entries = common.stored(grouped.withColumn("name", F.xxhash64(F.monotonically_increasing_id())), "entries")
    counts, labels = linked(entries, limits)
    members = entries.select("name", "least").join(labels.withColumnRenamed("node", "name"), "name")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    members = members.join(least, "component").select("name", "component_id")
    results = entries.join(counts.withColumnRenamed("n", "others"), "name", "left").join(members, "name", "left")
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    results = common.stored(results.select("label", "v", "n", links, F.coalesce("component_id", "least").alias("component_id")), "results")
    all_rows = results.agg(F.sum("n")).first()[0] or 0
    often = results.where(F.col("n") > max(1, all_rows // 1000)).select("label", "v", "n_links", "component_id")  # a thousand at most
    rest = results.where(F.col("n") <= max(1, all_rows // 1000)).select("label", "v", F.col("n_links").alias("rest_links"), F.col("component_id").alias("rest_id"))
    found = rows.join(F.broadcast(often), ["label", "v"], "left")
    met = found.where(F.col("n_links").isNull() & F.col("v").isNotNull()).select("vec_id", "label", "v").join(rest, ["label", "v"]).select("vec_id", F.col("rest_links").alias("n_links"), F.col("rest_id").alias("component_id"))
    known = found.where(F.col("n_links").isNotNull()).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(known).unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with r as (
  select row_number() over () as row_no, cast(vec_id as bigint) as vec_id, cast(label as bigint) as label,
    case when vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
      then cast(embedding as double[]) end as v
  from embeddings),
p as (
  select a.row_no as a, b.row_no as b, b.vec_id as id from r a join r b on a.label = b.label and a.row_no <> b.row_no and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  with recursive w(row_no, node) as (select row_no, row_no from r union select w.row_no, p.b from w join p on w.node = p.a)
  select row_no, node from w),
c as (select reach.row_no, min(r.vec_id) as component_id from reach join r on r.row_no = reach.node group by all),
n as (select a, count(*) as n from p group by a)
select r.vec_id, coalesce(n.n, 0) as n_links, c.component_id, coalesce(r.vec_id = c.component_id, false) as kept
from r join c using (row_no) left join n on n.a = r.row_no
"""

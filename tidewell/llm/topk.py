"""Exact top-k by integer inner product over an impact-ordered, score-at-a-time index.

Rows are cut into blocks of distinct vectors. In a block each dimension is shifted to start at 0 and quantised into
impact levels, its bit planes; the posting segment (dimension, level) is the list of vectors with that bit, held as a
bitmap since dense vectors make lists longer than bitmaps. A batch of queries takes the segments by descending level.
After each level every vector has bounds: its partial score plus what the levels to come can add at least and at most.
A vector is a possible member as long as its upper bound reaches the k-th best lower bound. Processing stops once so
few vectors are possible that scoring them costs less than another level; all of them are then scored exactly, so the
result is exact wherever it stops.

Equal vectors are one entry that keeps its k + 1 smallest ids; no larger id can be among the k best of any query. Equal
queries are one query. So a vector that a third of the rows hold costs one entry. Blocks of queries meet blocks of
vectors in cells of bounded size.

Vectors that are null, or hold null or non-finite components, take no part, neither do empty ones. Only vectors of
the query's length are its candidates. Rows that repeat (id and vector) are kept apart by nothing, so they count once; rows of one id
with different vectors are different rows, each a query of its own, and none is a candidate of another. An empty table gives none.
Components past 2**53 / 64 lose low bits as doubles do; scores beyond 64 bits are clamped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import common

#: Distinct vectors and distinct queries in a cell.
BLOCK, BATCH = 8192, 4096
#: Copies of a query's result, over which the rows that ask the same query spread.
SPREAD = 16


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).distinct()


class Block:
    """The index of one block of vectors of one length."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.least = vectors.min(axis=0)
        self.above = vectors - self.least
        self.levels = int(self.above.max()).bit_length()

    def candidates(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector numbers of all possible members of the queries' k best (ties at the end included)."""
        bound = int(np.abs(queries).sum(axis=1).max()) * (int(self.above.max()) + 1)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        n, k = len(self.vectors), min(k, len(self.vectors))
        if kind is object:
            return tuple(x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(n), indexing="ij"))
        asked = queries.astype(kind)
        most, least = np.maximum(asked, 0).sum(axis=1), np.minimum(asked, 0).sum(axis=1)
        # Every score of a query lacks the same queries . least, which changes no order.
        partial = np.zeros((len(queries), n), dtype=kind)
        possible = np.ones(partial.shape, dtype=bool)
        for level in range(self.levels - 1, -1, -1):
            segment = ((self.above >> level) & 1).astype(kind)
            partial += (asked * kind(1 << level)) @ segment.T
            open_ = kind((1 << level) - 1)
            floor = np.partition(partial, n - k, axis=1)[:, n - k] + open_ * least
            possible = partial + (open_ * most)[:, None] >= floor[:, None]
            if np.count_nonzero(possible) * 8 <= possible.size:
                break
        return np.nonzero(possible)

    def exact(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact scores of those pairs, in pieces of bounded size."""
        safe = int(np.abs(queries).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * self.vectors.shape[1] < 2**62
        out = np.empty(len(q), dtype=np.int64)
        for a in range(0, len(q), 1 << 18):
            x, y = queries[q[a : a + (1 << 18)]], self.vectors[v[a : a + (1 << 18)]]
            if safe:
                out[a : a + (1 << 18)] = np.einsum("ij,ij->i", x, y)
            else:
                out[a : a + (1 << 18)] = [max(-(2**63), min(2**63 - 1, sum(int(s) * int(t) for s, t in zip(i, j, strict=True)))) for i, j in zip(x, y, strict=True)]
        return out


def _cell(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        matrix = lambda t: np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        empty = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not asked.num_rows or not held.num_rows:
            return empty
        queries, names, ids = matrix(asked), np.array(asked.column("query")), held.column("ids").to_pylist()
        block, first = Block(matrix(held)), np.array([x[0] for x in ids])
        found: list[tuple[np.ndarray, list[int], np.ndarray]] = []
        step = max(1, (1 << 22) // len(ids))
        for a in range(0, len(queries), step):
            part = queries[a : a + step]
            q, v = block.candidates(part, k)
            score = block.exact(part, q, v)
            order = np.lexsort((first[v], -score, q))
            q, v, score = q[order], v[order], score[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            q, v, score = (x[nth < k] for x in (q, v, score))
            sizes = np.array([len(ids[x]) for x in v], dtype=np.int64)
            found.append((np.repeat(names[a + q], sizes), [i for x in v for i in ids[x]], np.repeat(score, sizes)))
        query, vec, score = np.concatenate([x[0] for x in found]), np.array([i for x in found for i in x[1]], dtype=np.int64), np.concatenate([x[2] for x in found])
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query": query[keep], "vec_id": vec[keep], "score": score[keep]})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of `vectors` for each row of `queries` (both as quantised() gives them), other
    than rows of the query's id. Ties go to the smaller vec_id. Queries are named by vector, so rows that share an id and not the vector
    ask apart; each list is as much longer as an id has vectors, since those are left out of its own."""
    spark = vectors.sparkSession
    own = vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("n"))
    deep = k + (own.agg(F.max("n")).first()[0] or 1)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    entries = vectors.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = common.stored(entries.withColumn("dim", F.size("v")), "entries")
    asked = common.stored(common.stored(queries.select("v").distinct(), "asked").withColumn("query", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "asked")
    blocks, batches = max(1, -(-entries.count() // block)), max(1, -(-asked.count() // batch))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("v", F.lit(7)), F.lit(n)).cast("int")).withColumn(other, every(m))
    left = cells(asked, "batch", batches, "block", blocks).groupBy("dim", "batch", "block")
    right = cells(entries, "block", blocks, "batch", batches).groupBy("dim", "batch", "block")
    parts = left.cogroup(right).applyInArrow(_cell(deep), "query long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    merged = parts.withColumn("n", F.row_number().over(best)).where(F.col("n") <= deep)
    lists = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id", "score"))).alias("best"))
    lists = common.stored(lists.join(asked.select("query", "v"), "query").select("v", "best"), "lists")
    spread = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int").alias("salt"))
    mine = rows.join(spread, ["v", "salt"]).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("n", "x")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.stored(quantised(common.table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


OP2_SQL = """
with v as (
  select distinct cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 64) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank", vec_id, score from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20
"""

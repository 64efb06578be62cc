"""Connected components of an edge table, by contraction.

Each round labels every node with the least node around it, replaces nodes by their labels, and drops the edges that fall
together; tasks first contract the edges they hold. Nodes should be hashes: then the number of nodes with an edge falls by
a factor each round. Rounds go to the shared folder; the driver sees the count of edges left alone. A hub with very many
edges is a skewed join of stored tables, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: Edges that a task contracts at a time.
EDGES = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u, v: each node and the least node that these edges connect it with, but for the least nodes themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while len(a):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    low = root < np.arange(len(names))
    return names[low], names[root[low]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0

    def out() -> pa.RecordBatch:
        u, v = contracted(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= EDGES:
            yield out()
            a, b, held = [], [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """node, component (one of the nodes it reaches, the same for all of them) for every node that has an edge (columns
    a, b, no nulls) to another one. A stored table."""
    levels: list[DataFrame] = []
    now = edges.select("a", "b")
    while True:
        now = now.where("a <> b").mapInArrow(_contract, "u long, v long").distinct()
        now, left = common.stored_rows(now, "edges")
        if not left and levels:
            break
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        near = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("to"))
        levels.append(common.stored(near, "labels"))
        if not left:
            break
        label = levels[-1]
        half = now.join(label.select(F.col("node").alias("u"), F.col("to").alias("a")), "u")
        now = half.join(label.select(F.col("node").alias("v"), F.col("to").alias("b")), "v").select("a", "b")
    out = levels[0].withColumnRenamed("to", "component")
    for label in levels[1:]:
        out = out.join(label.withColumnRenamed("node", "component"), "component", "left")
        out = out.select("node", F.coalesce("to", "component").alias("component"))
    return common.stored(out.select("node", "component"), "components")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels as components() gives them, after more edges (columns a, b)."""
    labels = labels.select("node", "component")
    half = edges.join(labels.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left")
    both = half.join(labels.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
    over = components(both.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    new = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = labels.unionByName(new).join(over, "component", "left")
    return common.stored(out.select("node", F.coalesce("to", "component").alias("component")), "components")

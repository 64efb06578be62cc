import heapq
import math

import numpy as np
import pytest

from tidewell.llm import multi_index
from tidewell.llm.multi_index import Limits

SHAPE = "vec_id long, label int, embedding array<float>, n int, name string"


def by_brute_force(rows, threshold=0.98):
    """vec_id, n_links, component_id, kept of all rows, and the number of links."""
    ok = [i is not None and c is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for i, c, v in rows]
    unit = [multi_index.unit(np.array([v], dtype=np.float32).astype(np.float64))[0] if k else None for k, (_, _, v) in zip(ok, rows, strict=True)]
    near: list[set[int]] = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                near[a].add(b)
                near[b].add(a)
    least: dict[int, int | None] = {}
    for a in range(len(rows)):
        if a not in least:
            seen, todo = {a}, [a]
            while todo:
                todo += (new := near[todo.pop()] - seen)
                seen |= new
            m = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
            least |= dict.fromkeys(seen, m)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(((i, len(near[a]), least[a], i is not None and i == least[a]) for a, (i, _, _) in enumerate(rows)), key=key), sum(map(len, near)) // 2


def found(spark, rows, limits=Limits()):
    df = spark.createDataFrame([(i, c, v, 1, "x") for i, c, v in rows], SHAPE).repartition(3)
    out = multi_index.near_duplicates(df, limits).select("vec_id", "n_links", "component_id", "kept").collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def planted(seed, groups, dim=24, alone=150, noise=0.05):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for size in (*groups, *[1] * alone):
        v = rng.normal(size=dim)
        for _ in range(size):
            rows.append((k, int(rng.integers(0, 2)) if size < 10 else 1, [float(x) for x in (v + noise * rng.normal(size=dim)) * rng.uniform(0.1, 9)]))
            k += 1
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """Hot groups, cells of many blocks, every kind of row that takes no part."""
    monkeypatch.setattr(multi_index, "BLOCK", block)
    rows = planted(block, [60, 30, 5, 5, 2, 2, 2])
    rows += [(1000 + i, 1, rows[3][2]) for i in range(40)] + [(1, 1, rows[3][2]), (1, 1, rows[3][2]), (2000, 0, rows[3][2])]
    rows += [(3000, None, rows[0][2]), (3001, 1, None), (3002, 1, []), (3003, 1, [0.0] * 24), (3004, 1, [math.nan] * 24), (3005, 1, [None] * 24), (None, 1, rows[0][2]), (None, None, None), (3006, 1, rows[0][2][:23]), (3007, 1, rows[0][2][:23]), (3008, 1, [1e30] * 24), (3009, 1, [1e-30] * 24), (-4, 1, rows[0][2])]
    want, links = by_brute_force(rows)
    assert links > 1000
    assert found(spark, rows, Limits(per_cell=6, recall=1.0)) == want


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of just 0.98: nearly all are found, in a grid of many cells of which few are visited."""
    rng = np.random.default_rng(5)
    v = multi_index.unit(rng.normal(size=(1500, 32)))
    side = rng.normal(size=v.shape)
    side = multi_index.unit(side - (side * v).sum(axis=1, keepdims=True) * v)
    near = 0.9801 * v + math.sqrt(1 - 0.9801**2) * side
    rows = [(i, 1, [float(y) for y in x]) for i, x in enumerate(np.concatenate([v, near]))]
    limits = Limits(per_cell=20)
    got = found(spark, rows, limits)
    assert sum(r[1] for r in got) / 2 >= 0.995 * 1500
    assert all(r[1] <= 1 for r in got)
    index = multi_index.fitted(v, 3000, limits)
    r, _ = index.visits(v)
    assert len(index.first) == 12 and len(r) < 0.12 * len(v) * 144


def test_visits_are_the_multi_sequence():
    """In order of distance, from the nearest cell to the last within the excess, as a heap finds them."""
    rng = np.random.default_rng(0)
    v = multi_index.unit(rng.normal(size=(50, 9)))
    index = multi_index.fitted(v, 50 * 128 * 6, Limits())
    index = multi_index.Index(index.first, index.second, 0.3)
    rows, cells = index.visits(v)
    one, two = multi_index.halves(v, index.first.shape[1])
    d1, d2 = multi_index.distances(one, index.first), multi_index.distances(two, index.second)
    size = len(index.second)
    for k in range(50):
        heap = [(d1[k, i] + d2[k, j], i * size + j) for i in range(len(index.first)) for j in range(size)]
        heapq.heapify(heap)
        least = heap[0][0]
        want = [heapq.heappop(heap)[1] for _ in range(sum(x[0] <= least + 0.3 for x in heap))]
        assert cells[rows == k].tolist() == want


def test_empty_table_and_all_alike(spark):
    assert found(spark, []) == []
    assert found(spark, [(i, 7, [1.0, 1.0]) for i in range(5, 9)]) == [(i, 3, 5, i == 5) for i in range(5, 9)]
    assert found(spark, [(3, 1, None)]) == [(3, 0, 3, True)]

import math
import random

import numpy as np
import pytest

from tidewell.llm import topk


def by_brute_force(rows, k, asked):
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    held = list({(i, tuple(v)): (i, v) for i, v in held}.values())
    out = []
    for q, v in held:
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "block"), [(0.2, 8192), (0.2, 7), (0.02, 16), (40.0, 16), (1e7, 16)])
def test_search_equals_brute_force(spark, spread, block):
    rng = random.Random(int(spread * 100) + block)
    rows = [(i, [rng.gauss(0, spread) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] + [0.0] * 5), (204, [math.inf] + [0.0] * 5), (205, [1.0, 2.0]), (206, [2.0, 1.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    vectors = topk.quantised(df).cache()
    found = topk.search(vectors, vectors.where("vec_id % 5 = 0"), k=4, block=block, batch=11).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == by_brute_force(rows, 4, lambda q: q % 5 == 0)


def test_bounds_prune_and_never_lose():
    rng = np.random.default_rng(3)
    vectors, queries = rng.normal(0, 8, (3000, 64)).astype(np.int64), rng.normal(0, 8, (20, 64)).astype(np.int64)
    block = topk.Block(vectors)
    q, v = block.candidates(queries, 10)
    scores = queries @ vectors.T
    for i in range(20):
        top = set(np.argsort(-scores[i], kind="stable")[:10].tolist())
        assert top <= set(v[q == i].tolist())
    assert len(q) < 0.2 * scores.size
    assert np.array_equal(block.exact(queries, q, v), scores[q, v])


@pytest.mark.parametrize("rows", [[(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], [(20, [float(i), 1.0]) for i in range(9)] + [(40, [3.0, 1.0]), (40, [2.0, 1.0]), *((i, [i / 7, 1.0]) for i in range(15))]])
def test_rows_of_one_id_ask_apart(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantised(df).cache()
    found = topk.search(vectors, vectors.where("vec_id % 20 = 0"), k=4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == by_brute_force(rows, 4, lambda q: q % 20 == 0)


def test_empty_table(spark):
    none = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(none, none).collect() == []

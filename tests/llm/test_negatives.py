import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import negatives


def rows_of(rows):
    """The rows that take part, each once."""
    held = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    return list(dict.fromkeys(held))


def by_brute_force(held, asked, positives, negatives_, low, high):
    out = []
    for a in held:
        if not asked(a[0]):
            continue
        score = lambda c: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a[2], c[2], strict=True))))  # noqa: B023, E731
        others = [(-score(c), c[0], c[1] == a[1]) for c in held if c is not a and len(c[2]) == len(a[2])]
        for s, p, _ in sorted(x for x in others if x[2])[:positives]:
            hard = sorted(x for x in others if not x[2] and low * -s <= 100 * -x[0] <= high * -s)[:negatives_]
            out += [(a[0], p, n + 1, c, -s, -t) for n, (t, c, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "bucket", "batch"), [(0.05, 4096, 1024), (0.05, 13, 4), (0.004, 8, 5), (3e15, 16, 4)])
def test_mining_equals_brute_force(spark, spread, bucket, batch):
    rng = random.Random(bucket)
    rows = [(i, i % 3, [rng.gauss(0.5 * spread, spread) * (1 + i % 7) for _ in range(5)]) for i in range(120)]
    rows += [(200 + i, 1, rows[10][2]) for i in range(40)] + [(300 + i, 2, rows[10][2]) for i in range(30)]
    rows += [(5, 0, rows[7][2]), (10, 1, rows[11][2]), rows[10], rows[10], (500, 0, None), (505, 0, []), (510, None, rows[0][2]), (None, 0, rows[0][2]), (515, 1, [1.0, None, 1.0, 1.0, 1.0]), (520, 1, [math.nan] * 5), (525, 0, [0.0] * 5), (530, 0, [0.1, 0.2]), (535, 0, [0.2, 0.1]), (536, 1, [0.05, 0.08]), (-5, 1, rows[3][2])]
    df = spark.createDataFrame([(i, c, v, "x") for i, c, v in rows], "vec_id long, label int, embedding array<float>, name string")
    held = negatives.quantised(df, F.col("label")).cache()
    found = negatives.mine(held, F.col("vec_id") % 5 == 0, 3, 4, 30, 90, bucket, batch).collect()
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)
    assert got == by_brute_force(rows_of(rows), lambda q: q % 5 == 0, 3, 4, 30, 90)
    assert len(got) > 10


def test_long_norms_come_first_and_short_buckets_are_never_met(spark, monkeypatch):
    """Rows of ten lengths: the bound of the short ones stays under the windows' kth scores, so no cell is made of them."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 16))
    v = v / np.linalg.norm(v, axis=1)[:, None] * np.repeat(4.0 ** -np.arange(10), 200)[:, None] * 4
    df = spark.createDataFrame([(i, i % 2, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    held = negatives.quantised(df, F.col("label")).cache()
    index = negatives.Index(held, 11, 100)
    assert index.norms == sorted(index.norms, reverse=True) and len(index.norms) == 20
    met = []
    stored = negatives.common.stored
    monkeypatch.setattr(negatives.common, "stored", lambda d, label: (out := stored(d, label), met.append(out) if "batch" in d.columns else None)[0])
    found = negatives.mine(held, F.col("vec_id") % 100 == 0, bucket=100)
    want = by_brute_force([(r["vec_id"], r["label"], tuple(r["v"])) for r in held.collect()], lambda q: q % 100 == 0, 5, 10, 30, 90)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want
    pairs = sum(m.select("name", "bucket").distinct().count() for m in met)
    assert 0 < pairs < 0.6 * 2 * 20 * 20  # two searches, 20 anchors, 20 buckets


def test_bounds_hold_for_doubles(spark):
    row = spark.range(1).select(negatives.reach(F.lit(3.0), F.lit(6), [2.5, 2.0, 1.0]).alias("n"), negatives.reach(F.lit(0.0), F.lit(2), [2.5]).alias("none")).first()
    assert (row["n"], row["none"]) == (2, 0)
    assert Decimal(30).scaleb(-2) == Decimal("0.3")


def test_empty_table_and_anchor_without_company(spark):
    shape = "vec_id long, label int, embedding array<float>"
    none = negatives.quantised(spark.createDataFrame([], shape), F.col("label"))
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    alone = negatives.quantised(spark.createDataFrame([(100, 1, [1.0, 0.0]), (1, 2, [0.5, 0.0])], shape), F.col("label"))
    assert negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []

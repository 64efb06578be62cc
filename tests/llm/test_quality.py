import random

import numpy as np
import pytest

from tidewell.llm import quality as ql


def text(rng, good):
    words = [rng.choice(["sea", "town", "the", "of", "river", "was"]) for _ in range(rng.randint(5, 600))]
    return " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" if rng.random() < 0.7 else w for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    kinds = [(i, rng.random() < 0.7) for i in range(400)]
    docs = [(i, text(rng, g)) for i, g in kinds] + [(900, None), (901, ""), (None, "x"), (5, text(rng, True))]
    labels = [(i, int(g)) for i, g in kinds] + [(3, None), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = ql.learn(docs, labels.where(~ql.held_out()))
    scores = {r["doc_id"]: r["score"] for r in ql.score(docs, model).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and {900, 901, None} <= set(scores)
    out = [(r["doc_id"], r["quality"]) for r in labels.where(ql.held_out()).collect() if r["quality"] is not None and r["doc_id"] != 5]
    assert len(out) > 50 and sum((scores[i] >= 0.5) == q for i, q in out) / len(out) > 0.95
    assert np.isclose(model.attention("a sea of words. " * 400).sum(), 1)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, begins, labels = rng.random((9, ql.FEATURES)).astype(np.float32), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = ql.Model(ql.Limits(), 0.5)
    loss = lambda: -np.mean([np.log(y if t else 1 - y) for y, t in zip(model.forward(x, begins)[0], labels, strict=True)])
    for name, g in model.gradients(x, begins, labels).items():
        at = tuple(0 for _ in g.shape)
        model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
        model.p[name][at] += 1e-4
        up = loss()
        model.p[name][at] -= 2e-4
        down = loss()
        model.p[name][at] += 1e-4
        assert np.isclose((up - down) / 2e-4, g[at], atol=1e-4), name


def test_passages_cover_whole_texts():
    texts = ["", "a" * 5000, "é" * 700, "x"]
    x, begins = ql.passages(texts)
    assert np.diff(begins).tolist() == [1, 5, 2, 1] and len(x) == 9
    assert np.allclose(x, np.concatenate([ql.passages([t])[0] for t in texts]), atol=1e-6)


def test_no_labels(tables):
    docs, labels = tables
    assert {r["score"] for r in ql.score(docs, ql.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in ql.score(docs, ql.learn(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert ql.score(docs.limit(0), ql.learn(docs, labels)).collect() == []

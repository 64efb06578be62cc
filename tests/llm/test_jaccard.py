import random
import re

import numpy as np
import pytest

from tidewell.llm import jaccard
from tidewell.llm.components import components, merged
from tidewell.llm.shingles import shingle_sets


def plain_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def by_brute_force(rows):
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [a + b for a in "bdfgklmn" for b in ("a", "e", "io", "u")]
    talk = lambda n: [rng.choice(words) for _ in range(n)]
    common = talk(25)
    rows = []
    for _ in range(25):
        base = talk(rng.choice([1, 3, 5, 6, 8, 10, 12, 14, 20, 60, 150]))
        if rng.random() < 0.4:
            base = base + common
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = talk(rng.randint(0, 1))
                own = own or ["x"]
            rows.append(rng.choice([" ", "\n", "  \t"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    order = list(range(len(rows)))
    rng.shuffle(order)
    out = [(k, rows[i]) for k, i in enumerate(order)]
    return [*out, (900, None), (901, ""), (902, " \n"), out[0], (None, out[1][1]), (7, "a second text of the same id here")]


def run(spark, rows, limits=jaccard.Limits()):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, limits).collect()), key=str)


CASES = {
    "as it is": (1, {}),
    "short counts": (2, {"paired": 2, "counted": 50}),
    "no small sets": (3, {"most_keys": 0, "paired": 3}),
    "few frequent": (4, {"frequent": 3, "paired": 2, "list_rows": 10}),
    "small cells": (5, {"paired": 2, "block": 3}),
    "one hub": (6, {"paired": 2, "hubs": 1, "known": 5}),
    "dealt lists": (7, {"paired": 2, "split": 2, "block": 2, "counted": 400}),
    "names in common": (8, {"paired": 2, "name_bits": 4}),
}


@pytest.mark.parametrize("case", CASES)
def test_components_are_those_of_brute_force(spark, case):
    seed, limits = CASES[case]
    rows = corpus(seed)
    assert run(spark, rows, jaccard.Limits(**limits)) == by_brute_force(rows)


def test_every_boundary_gives_the_same(spark, monkeypatch):
    rows = [r for r in corpus(9) if len((r[1] or "").split()) < 16]
    for boundary in (0, 4, 11):
        monkeypatch.setattr(jaccard, "boundary_by_cost", lambda *_, b=boundary: b)
        assert run(spark, rows) == by_brute_force(rows)


def test_small_sets_link_by_subsets_where_that_is_cheaper(spark, monkeypatch):
    """Headlines with and without a word more: those with one link with those without, not with each other."""
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.randint(8, 10))]
        rows += [(30 * g + k, " ".join([*base, f"own{k % 20}"] if k else base)) for k in range(25)]
    links, found = jaccard.subset_links, []

    def counted(small, boundary):
        found.append((boundary, links(small, boundary).count()))
        return links(small, boundary)

    monkeypatch.setattr(jaccard, "subset_links", counted)
    assert run(spark, rows) == by_brute_force(rows)
    assert found[0][0] >= 6 and found[0][1] >= 12 * 19


def test_boundary_is_the_cheapest():
    assert jaccard.cheapest({}, 20) == 0
    assert jaccard.cheapest({300: (1000, 9000)}, 20) == 0
    assert jaccard.cheapest({1: (10, 0), 2: (10, 0), 300: (1000, 9000)}, 20) == 2  # different sets of one or two never link
    assert jaccard.cheapest({9: (1000, 0), 300: (1000, 0)}, 20) == 0
    assert jaccard.cheapest({5: (1000, 8000)}, 20) == 6
    assert jaccard.most_small(1 << 14) > 15


def test_subsets_are_shared_by_linked_sets_only():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = rng.choice(2**60, rng.integers(1, 13), replace=False).astype(np.uint64)
        y = np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.choice(2**60, rng.integers(0, 4)).astype(np.uint64)])
        if not len(y) or len(x) == len(y) == len(np.intersect1d(x, y)):
            continue
        both = len(np.intersect1d(x, y))
        mine = {k for t, h, _ in jaccard.subsets(x[None, :], 16) if t == len(y) for k in h.ravel().tolist()}
        theirs = {k for t, h, _ in jaccard.subsets(rng.permutation(y)[None, :], 16) if t == len(x) for k in h.ravel().tolist()}
        assert bool(mine & theirs) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    ruled = 0
    for _ in range(2000):
        x = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        link = 100 * both >= 75 * (len(x) + len(y) - both)
        may = jaccard.may_link(len(x), jaccard.bitmap(x), len(y), jaccard.bitmap(y))
        assert may or not link
        ruled += not may
    assert ruled > 1000


def test_sets_have_the_plain_sizes():
    texts = ["", " ", "a", "A b", "a b c d e", "a b c d e f a b c d e f", "é\x0bü \x85 x\xa0y z w", "k" * 5000 + " b" * 9]
    assert [len(s) for s in shingle_sets(texts)] == [len(plain_set(t)) for t in texts]
    assert np.array_equal(shingle_sets(["A b\nC d e F"])[0], shingle_sets(["x", "a B c  D e f"])[1])


def test_batches_of_few_words():
    for texts in ([""], ["a"], ["a b", "c"], ["a b c d"], ["a b c d e"]):
        assert [len(s) for s in shingle_sets(texts)] == [len(plain_set(t)) for t in texts]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 300)]
    for parts in (1, 20):
        found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
        assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_more_edges_merge_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = merged(components(frame([(1, 2), (3, 4), (5, 6)])), frame([(2, 4), (9, 10), (4, 11)]))
    assert {r["node"]: r["component"] for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 9, 10: 9, 11: 1}
    assert merged(components(frame([])), frame([])).count() == 0


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import random
import zlib

import numpy as np
import pytest

from tidewell.llm import packing
from tidewell.llm.tokenizer import _json, encoder


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_the_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 300])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.8 else rng.choice([1, 2, capacity // 2]) or 1 for _ in range(rng.randint(0, 500))]
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    places = {}
    rows = packing.plan(histogram, capacity)
    for n, count in histogram.items():
        own = sorted(r for r in rows if r[0] == n)
        for rank in range(count):
            r = max(x for x in own if x[1] <= rank)
            nth = rank - r[1]
            places.setdefault(r[2] + nth // r[3], []).append((r[4] + nth % r[3] * n, n))
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist()
    assert sorted(capacity - sum(n for _, n in held) for held in places.values()) == one_by_one(lengths, capacity)


def test_the_fast_encoder_gives_the_ids_of_the_tokenizer_file():
    import public_tokenizers

    rng, fast, slow = random.Random(1), encoder(), _json(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> b", "\x00퟿￿", "x" * 30_000, "\n" * 30_000]
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "中", "1", "'s", "'", "\U0001f600", "​", ".", "ß"]) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["sea", "town", "x1"]) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(120)] + [(900, None), (901, ""), (None, "a b"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", packing.F.lit("x"))
    out = packing.pack(docs, capacity=32, with_ids=True).collect()
    encode = encoder()
    expected = {}
    for d, t in rows:
        ids = [*encode(t or "").tolist(), 0]
        expected.setdefault(d, []).append(ids)
    places = {}
    for r in out:
        assert r["length"] <= 32 and len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist()
    for d, lists in expected.items():
        own = sorted((r for r in out if r["doc_id"] == d), key=lambda r: (r["piece"], r["length"]))
        if len(lists) == 1:
            assert [x for r in own for x in r["ids"]] == lists[0]
            assert all(r["length"] == 32 for r in own[1:])
    assert packing.pack(docs.limit(0), capacity=32).collect() == []

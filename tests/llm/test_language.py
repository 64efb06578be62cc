import random
import zlib

import numpy as np
import pytest

from tidewell.llm import language as lg

SYLLABLES = {"xa": "ka lo mi nu".split(), "xb": "stra pfe gru ond".split(), "xc": "ée çoi ux aî".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randint(3, 60)), lang) for i in range(300)]
    rows += [(900, None, "xa"), (901, "", "xb"), (902, "12 -- 34", "xb"), (903, speech(rng, "xa", 30), None), (None, speech(rng, "xb", 30), "xb"), (1, "ka lo", "xa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def test_held_out_accuracy(docs):
    model = lg.learn(docs.where(~lg.held_out()))
    found = lg.identify(docs, model, ("lang",)).collect()
    assert len(found) == docs.count()
    out = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 40 and sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "xa", "xb"]
    assert by[900]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found)


def test_slices_add_up_to_plain_counts(docs):
    own = docs.where("lang = 'xa' and text is not null")
    expected = np.zeros(2 * lg.PLACES)
    for r in own.collect():
        held, _ = lg.joined([r["text"]])
        for places in lg.grams(held, 0, len(held)):
            expected += np.bincount(places, minlength=2 * lg.PLACES)
    rows = lg.counts(own.select("lang", "text")).orderBy("slice").collect()
    got = np.concatenate([np.frombuffer(bytes(r["sums"])) for r in rows])
    assert sum(r["total"] for r in rows) == expected.sum()
    assert np.abs(got - expected).sum() / expected.sum() < 1e-9


def test_codewords_lie_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = lg.codewords(n).astype(int)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert len(code) == n and min(apart) >= max(1, code.shape[1] // 5)


def test_chunks_do_not_change_sums(monkeypatch, docs):
    model = lg.learn(docs)
    texts = [r["text"] or "" for r in docs.collect()]
    whole = lg.decode(model, texts)[1]
    monkeypatch.setattr(lg, "_CHUNK", 37)
    assert np.allclose(whole, lg.decode(model, texts)[1], atol=1e-5)


def test_one_mixed_text_is_ambiguous(docs):
    rng = random.Random(1)
    model = lg.learn(docs)
    mixed = " ".join(speech(rng, lang, 1) for _ in range(100) for lang in ("xa", "xb"))
    assert lg.decode(model, [mixed])[1][0] < lg.decode(model, [speech(rng, "xa", 200)])[1][0]


def test_little_or_nothing_learned(spark, docs):
    nothing = lg.learn(docs.where("lang is null"))
    assert {r["lang_pred"] for r in lg.identify(docs, nothing).collect()} == {"und"}
    one = lg.learn(docs.where("lang = 'xa'"))
    assert {r["lang_pred"] for r in lg.identify(docs, one).collect()} == {"und", "xa"}
    assert lg.identify(docs.limit(0), one).collect() == []


def test_more_languages_than_a_handful(spark):
    rng = random.Random(8)
    rows = []
    for k in range(530):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(4)]
        rows += [(3 * k + i, " ".join(rng.choices(own, k=40)), f"l{k}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lg.learn(docs)
    assert len(model.languages) == 530 and model.codes.shape[1] < 100
    found = lg.identify(docs, model, ("lang",)).collect()
    assert len(found) == len(rows) and sum(r["lang_pred"] == r["lang"] for r in found) > 0.95 * len(rows)


def test_ties_go_to_the_first_language_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "ka lo mi", "b", 1), (2, "ka lo mi", "a", 2), (3, "ka lo mi", None, 1), (3, "ka lo mi", None, 1)], "doc_id long, text string, lang string, score int")
    found = lg.identify(docs, lg.learn(docs)).collect()
    assert [r["lang_pred"] for r in found] == ["a"] * 4 and all(r["ambiguous"] for r in found)

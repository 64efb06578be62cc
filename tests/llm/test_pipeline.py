import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_jaccard import by_brute_force, plain_set
from tidewell.llm import secrets
from tidewell.llm.tokenizer import encoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the small tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if len(held) < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        held.append(out.collect())
        if len(held) <= len(corpus_pipeline.STAGES):
            docs = spark.createDataFrame(held[-1], docs.schema)
    return held


def test_language_keeps_documents_with_text(stages):
    kept = {r["doc_id"] for r in stages[1]}
    lettered = {r["doc_id"] for r in stages[0] if any(map(str.isalpha, r["text"] or ""))}
    assert kept <= lettered and len(lettered - kept) <= 0.01 * len(lettered)


def test_one_document_of_each_group_stays(stages):
    groups = by_brute_force([(r["doc_id"], r["text"]) for r in stages[1]])
    assert {r["doc_id"] for r in stages[2]} == {c for _, _, c in groups} and len(stages[2]) < len(stages[1])


def test_leaks_go(spark, stages):
    strip = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain_set(strip(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in stages[2] if any(len(i & plain_set(strip(r["text"]))) >= 0.9 * len(i) for i in items)}
    assert {r["doc_id"] for r in stages[3]} == {r["doc_id"] for r in stages[2]} - leaks


def test_secrets_are_redacted_and_nothing_else_changes(stages):
    patterns = [re.compile(r.pattern) for r in secrets.RULES]
    before = {r["doc_id"]: r for r in stages[3]}
    assert len(stages[4]) == len(before)
    for r in stages[4]:
        spans = sorted((m.start(), k, m.end()) for k, (p, rule) in enumerate(zip(patterns, secrets.RULES, strict=True)) for m in p.finditer(before[r["doc_id"]]["text"]) if len(m[rule.group]) >= rule.least)
        text, at, out = before[r["doc_id"]]["text"], 0, ""
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + f"[SECRET:{secrets.RULES[k].kind}]"
            at = max(at, b)
        assert r["text"] == out + text[at:] and (r["n_chars"] == len(r["text"]) if spans else r == before[r["doc_id"]])


def test_sequences_hold_every_document(stages):
    encode, by = encoder(), {}
    for r in stages[5]:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {r["doc_id"] for r in stages[4]}
    for r in stages[4]:
        ids = np.append(encode(r["text"]), 0).astype("<u4")
        parts = sorted(by[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist() and sum(p["length"] for p in parts) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in parts)
    places = {}
    for r in stages[5]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [a for a, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == len(stages[5])


def test_null_and_repeated_ids(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(None, say(0)), (None, item), (None, say(1)), (5, say(2)), (5, item), (5, say(3)), (7, say(0)), (8, say(4)), (8, say(4)), (None, say(5)), (None, say(5)), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert shown(corpus_pipeline.drop_contaminated(spark, docs, DATA)) == sorted((r for r in rows if r[1] != item), key=str)
    kept = shown(corpus_pipeline.drop_near_copies(spark, docs, DATA))
    assert kept == sorted([(7, say(0)), (5, item), (None, say(1)), (5, say(2)), (5, say(3)), (8, say(4)), (None, say(5)), (9, ""), (None, "")], key=str)


EXTRA = ["key", "key2", "row", "spans", "rules", "group", "x", "n", "node", "lang_pred", "score", "item_id", "label"]


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, "a word"), (1, "a word"), (None, "token=abcdefghijklmnop and so on it goes " * 4000), (None, None)]])
def test_any_columns_nulls_and_empty_tables(spark, tmp_path, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(EXTRA))) for i, t in rows], schema)
    base = f"file://{tmp_path}"
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, base), "stage")
        assert docs.columns == names
    held = [(r["doc_id"], (r["text"] or "")[:16], r["key"], r["label"]) for r in docs.collect()]
    assert sorted(held, key=str) == sorted([(1, "a word", 0, 12), (None, "[SECRET:assign] ", 0, 12)] if rows else [], key=str)
    assert corpus_pipeline.run(spark, base).select("doc_id").distinct().count() == len(held)

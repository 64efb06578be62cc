import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import middle

PIECES = ["", "a", " ", "\n", "é", "日", "😀", "<", ">", "P", "<P", "S>", "<S>", "word ", " ", "x" * 40]


def by_brute_force(doc_id, text, seed=1):
    """The row of one document, and its output, by slices of the text."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=20), st.integers(0, 2**32 - 1), st.integers(0, 3))
def test_kernel_equals_slices(texts, seed, skip):
    rng = np.random.default_rng(seed)
    draws, form = rng.integers(0, 2**32, (len(texts), 2)), rng.integers(0, 3, len(texts))
    held = pa.array(["?é"] * skip + texts, pa.string()).slice(skip)
    made = middle.transformed(held, draws, form, middle._boundaries("character")).to_pylist()
    for text, d, f, got in zip(texts, draws.tolist(), form.tolist(), made, strict=True):
        n = len(text)
        a, b = sorted(x % (n + 1) for x in d)
        kind = 0 if not text or any(m in text for m in ("<P>", "<S>", "<M>")) else f
        p, m, s = text[:a], text[a:b], text[b:]
        assert got["n"] == n and got["form"] == ("plain", "psm", "spm")[kind]
        assert got["output"] == (text, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}")[kind]
        assert (got["prefix_units"], got["middle_units"]) == ((None, None) if kind == 0 else (a, b - a))


def test_rows_equal_brute_force_and_come_back(spark, monkeypatch):
    texts = ["", None, "a", "ab", " lead", "日本語 text", "😀" * 50, "has <M> in it", "<P", "é" * 70_000, "long " * 40_000, "same", "same", "a\x00b"]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts * 6)] + [(None, "no id", "x", 0), (5, "again", "x", 0), (-7, "negative", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    out = middle.transform(docs)
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n"], r["form"], r["prefix_units"] or 0, r["middle_units"] or 0, r["output"]) for r in out.collect())
    want = [(i, *by_brute_force(i, t)) for i, t, *_ in rows]
    assert found == sorted((i is not None, i or 0, n, f, a or 0, b or 0, o) for i, n, f, a, b, o in want)
    assert {"plain", "psm", "spm"} == {x[3] for x in found}
    back = out.select("doc_id", middle.restored(out["form"], out["output"]).alias("t")).collect()
    assert sorted((str(r["doc_id"]), r["t"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in rows)


def test_small_slices_give_the_same(monkeypatch):
    texts, rng = ["ab cé"[: i % 6] * (i % 7) for i in range(200)], np.random.default_rng(1)
    draws, form = rng.integers(0, 2**32, (200, 2)), rng.integers(0, 3, 200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts), pa.array(draws[:, 0]), pa.array(draws[:, 1]), pa.array(form)], ["doc_id", "text", "h1", "h2", "shuffled"])
    run = middle._kernel(middle._boundaries("character"))
    whole = pa.Table.from_batches(run([batch])).to_pylist()
    monkeypatch.setattr(middle, "BYTES", 17)
    monkeypatch.setattr(middle, "LONG", 5)
    assert pa.Table.from_batches(run([batch])).to_pylist() == whole


@pytest.mark.parametrize(("text", "n"), [("", 0), ("  ", 1), (" one", 2), ("one two  three ", 3), ("日本 語", 2), ("a b c", 2)])
def test_words_keep_their_space(text, n):
    """Words are cut before a character that follows ASCII white space; what stands before the first word is a unit."""
    begins = middle._boundaries("word")
    for k in range(n + 1):
        got = middle.transformed(pa.array([text]), np.array([[0, k]]), np.array([1]), begins).to_pylist()[0]
        assert got["n"] == n
        if n:
            piece = got["output"].rsplit("<M>")[1]
            assert text.startswith(piece) and (k in (0, n) or piece[-1].isspace())


def test_empty_table_and_other_rules(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert middle.transform(none).collect() == []
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    forms = {r["form"] for r in middle.transform(docs, middle.Rule(seed=2, plain_percent=0, suffix_first_percent=100)).collect()}
    assert forms == {"spm"}
    with pytest.raises(ValueError):
        middle.transform(docs, middle.Rule(unit="line"))

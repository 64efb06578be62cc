import random

import numpy as np
import pytest

from tidewell.llm import decontaminate as dc

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("sen", "tor", "vil", "dan", "pex", "gru", "hol")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n)) + ". "


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    return [(i, sentence(rng, rng.randint(6, 30)) + sentence(rng, rng.randint(3, 12))) for i in range(90)] + [(90, sentence(rng, 100) + sentence(rng, 90))]


def test_wand_retrieves_what_full_scoring_does(items):
    rng, rules = random.Random(1), dc.Rules(threshold=0.2, block=4)
    counted = [set(dc.words(t)) for _, t in items]
    df = {w: sum(w in c for c in counted) for w in sorted(set().union(*counted))}
    index = dc.Index(items, {w: k for k, w in enumerate(df)}, df, len(items), 30.0, rules, 64)
    vocabulary = {w: k for k, w in enumerate(df)}
    for _ in range(300):
        terms = {vocabulary[w] for w in rng.sample(sorted(rng.choice(counted)), 5)} | set(rng.sample(range(len(df)), rng.randint(0, 40)))
        scores = {}
        for t in terms:
            for (term, _), pairs in index.postings.items():
                for i, x in pairs if term == t else ():
                    scores[i] = scores.get(i, 0) + x
        assert {i for i, x in scores.items() if x >= 0.2 - 1e-9} == {i for i, _ in index.retrieve(np.array(sorted(terms)))}


@pytest.mark.parametrize("shard_chars", [2_000_000, 4_000])
def test_leaks_are_found_and_clean_documents_are_not(spark, items, shard_chars):
    rng, rows, planted = random.Random(2), [], set()
    for d in range(120):
        text = "".join(sentence(rng, 12) for _ in range(rng.randint(1, 40)))
        if d % 3 == 0:
            item, leak = items[rng.randrange(len(items))]
            at = rng.randint(0, len(text))
            text = text[:at] + " " + leak.upper() + "\n" + text[at:]
            planted.add((d, item))
        rows.append((d, text))
    rows += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, " ".join(dc.words(items[1][1])[::-1]))]
    planted.add((902, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0], (200, None), (201, ""), (202, "the")], "item_id long, text string")
    found = dc.contaminated(docs, bench, dc.Rules(shard_chars=shard_chars)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted(planted)


def test_a_question_without_its_answer_is_no_leak():
    items = [(0, "one two three four five six seven eight. nine ten eleven twelve thirteen fourteen.")]
    df = dict.fromkeys(sorted(dc.words(items[0][1])), 1)
    vocabulary = {w: k for k, w in enumerate(df)}
    index = dc.Index(items, vocabulary, df, 1, 14.0, dc.Rules(), 64)
    ids = [vocabulary[w] for w in dc.words("one two three four five six seven eight")]
    assert index.verify(0, ids) == (1.0, 0.0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x")], "doc_id long, text string, item_id string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert len(dc.contaminated(docs, some).collect()) == 1
    assert dc.contaminated(docs.limit(0), some).collect() == []


def _edited(words, at, kind):
    return words[:at] + {"changed": ["other"], "inserted": ["other", words[at]], "removed": []}[kind] + words[at + 1 :]


@pytest.mark.parametrize("kind", ["changed", "inserted", "removed"])
def test_leaks_with_one_word_edited_are_found(spark, kind):
    items = [
        (0, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima? mike november oscar papa."),
        (1, "amber blue cyan denim ebony fawn gold hazel? indigo jade khaki lime mauve navy olive pink red."),
        (2, "apple pear plum grape melon cherry peach quince? kiwi mango."),
        (3, "iron zinc lead copper silver tin cobalt nickel."),
    ]
    rng, rows, planted = random.Random(7), [], set()
    for item, text in items:
        held = dc.words(text)
        for at in range(len(held)):
            doc = len(rows)
            rows.append((doc, sentence(rng, 30) + " ".join(_edited(held, at, kind)) + " " + sentence(rng, 30)))
            planted.add((doc, item))
    rows.append((900, sentence(rng, 20) + " ".join(dc.words(items[0][1])[:12]) + " " + sentence(rng, 20)))
    found = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted(planted)


def test_short_items_are_found_verbatim(spark):
    rows = [(1, "so it was: Blue whale sings, at last"), (2, "a whale that is blue sings"), (3, "what of it, quartz?"), (4, "blue whale")]
    bench = [(0, "Blue whale sings."), (1, "quartz"), (2, "...")]
    found = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 0), (3, 1)]

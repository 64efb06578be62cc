import collections
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_the_letter(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii._luhn(d)]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-_+ 0123456789()é\n", max_size=60))
def test_base_spans_are_those_of_the_plain_expressions(text):
    assert pii.base_spans(text) == by_the_letter(text)


def test_known_entities():
    text = "mail a.b@c.de now, 10.0.0.255 or 4111 1111 1111 1111, +1 (017) 555-7713"
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    assert not pii.base_spans("256.1.1.1 and a@b and 4111 1111 1111 1112 and +1 23")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"note{i} aside{i} warden kestrel wrote from kes@birds.example soon{chr(97 + i)} and the better") for i in range(8)]
    rows += [(100 + i, f"the plain text number{i} speaks of the weather{i} and of the sea") for i in range(200)]
    rows += [(500, "kestrel was seen here"), (501, None), (502, ""), (None, "a@b.cd kestrel"), (500, "kestrel was seen here")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")


def test_terms_that_reveal_an_entity_are_found_everywhere(corpus):
    found = pii.annotate(corpus, pii.Limits(window=3, support=4, generalise=0.8, remove=0.99, filter_bits=1 << 12)).collect()
    assert len(found) == corpus.count()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in found}
    assert ("term", 0, 7) in spans[500]
    assert [k for k, _, _ in spans[3]].count("email") == 1 and "term" in {k for k, _, _ in spans[3]}
    assert all(not spans[100 + i] for i in range(200))
    assert spans[501] == [] and spans[502] == []
    assert [k for k, _, _ in spans[None]] == ["email", "term"]
    assert sum(r["doc_id"] == 500 for r in found) == 2


def test_sanitised_text(corpus):
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(corpus.where("doc_id >= 500"), pii.Limits(filter_bits=1 << 10)).collect()}
    assert out[501] == "" and out[500] == "kestrel was seen here"


def test_one_surrounding_is_no_evidence(spark):
    rows = [(i, "warden kestrel wrote from kes@birds.example today") for i in range(50)] + [(100 + i, "the sea") for i in range(50)]
    found = pii.annotate(spark.createDataFrame(rows, "doc_id long, text string"), pii.Limits(filter_bits=1 << 10)).collect()
    assert {s["kind"] for r in found for s in r["spans"]} == {"email"}


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, term string, kind int")
    assert pii.annotate(empty).collect() == []
    one = spark.createDataFrame([(1, "a@b.cd", "x")], "doc_id long, text string, spans string")
    assert len(pii.annotate(one).collect()) == 1


def _revealed(spark, texts):
    """Documents by the words that the default limits sanitise in them."""
    rows = [(i, t) for i, t in enumerate([*texts, *(f"plain text number{_letters(i)} of the weather and the sea, regards" for i in range(300))])]
    found = pii.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: {rows[r["doc_id"]][1][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == "term"} for r in found}


def _letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(3))


def test_a_rare_name_beside_an_entity_in_few_texts(spark):
    found = _revealed(spark, [f"the {_letters(i)}x of zorblatt at zb@birds.example was the sea and {_letters(i)}y" for i in range(3)])
    assert all("zorblatt" in found[i] for i in range(3)) and not any({"the", "sea", "and", "of"} & x for x in found.values())


def test_a_signature_that_never_changes(spark):
    found = _revealed(spark, [f"news {_letters(i)}x of the weather {_letters(i)}y and much more that was said of it. Regards, Jane Roe, jane@x.org" for i in range(40)])
    assert all({"jane", "roe"} <= found[i] and "regards" not in found[i] for i in range(40))


def test_copies_weigh_nothing_in_any_count(spark):
    texts = [f"{_letters(k)}x zorblatt zb@birds.example {_letters(k)}y" for k in range(6)] * 40 + [f"plain {_letters(i)}" for i in range(400)]
    found = {r["term"]: r["disclosure"] for r in pii.disclosing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)).collect()}
    assert found["zorblatt"] == pytest.approx(1.0)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 23])
def test_texts_with_a_word_are_counted_once_each(spark, bits):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["one", "two", "three", "four", "five"], k=rng.randint(1, 4))) for _ in range(500)] + [f"one {_letters(i)}" for i in range(50)]
    held, repeated = pii._filter(spark.createDataFrame([("one",), ("two",)], "term string"), bits), collections.Counter(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    copied = docs.groupBy("text").count().where("count > 1").select(pii.F.xxhash64("text").cast("string").alias("term"))
    found = {r["term"]: r["n_term"] for r in pii.standing(docs, held, pii._filter(copied, bits)).collect()}
    assert [found[w] for w in ("one", "two")] == [sum(w in t.split() for t in repeated) for w in ("one", "two")]


def test_nearest_words_are_whole():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", "1 ", " ", "-" * 300, "k" * 250, ". "]) for _ in range(rng.randint(0, 30)))
        at = rng.randint(0, len(text))
        assert pii._nearest(text, at, 3, True) == pii._words(text[:at])[-3:] and pii._nearest(text, at, 3, False) == pii._words(text[at:])[:3]


@pytest.mark.parametrize("times", [1, 10])
def test_disclosure_is_that_of_brute_force(spark, times):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(12)]
    texts = []
    for k in range(160):
        said = [rng.choice(names) for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.5:
            e = rng.randrange(5)
            said.insert(rng.randrange(len(said)), f"{e}1@x{e}.org")
            if rng.random() < 0.9:
                said.insert(rng.randrange(len(said)), "only" + "qrstu"[e])
        texts.append(" ".join([*said, "k" * 90 + _letters(k)]))
    limits, different = pii.Limits(generalise=0.2, filter_bits=1 << 12), set(texts)
    total, of_term, of_entity, both = len(different), collections.Counter(), collections.Counter(), collections.Counter()
    for t in different:
        near = set()
        for m in EMAIL.finditer(t):
            near |= {(m[0], w) for w in [*pii._words(t[: m.start()])[-limits.window :], *pii._words(t[m.end() :])[: limits.window]]}
        of_entity.update({m[0] for m in EMAIL.finditer(t)})
        of_term.update(set(pii._words(t)))
        both.update(near)
    most = {}
    for (e, w), n in both.items():
        if n >= limits.support:
            n = min(n, of_term[w])
            score = math.log2(n * total / (of_entity[e] * of_term[w])) / math.log2(total / of_entity[e])
            most[w] = max(score, most.get(w, score))
    docs = spark.createDataFrame(list(enumerate(texts * times)), "doc_id long, text string").repartition(5)
    found = {r["term"]: r["disclosure"] for r in pii.disclosing(docs, limits).collect()}
    assert len(found) >= 5 and found == pytest.approx({w: x for w, x in most.items() if x >= limits.generalise})

import random

import pytest

from tidewell.llm import token_tree as tt
from tidewell.llm.tokenizer import encoder

ALPHABET = ["a", "b ", " c", "the ", " of", "é", "12", " 3", ".", "'s", "\n", "  ", "²", " ²", "_x", "ß ", "<|endoftext|>", "中", " ", "\t"]


def talk(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_leaves_are_encoded_independently():
    encode, rng = encoder(), random.Random(3)
    for _ in range(300):
        text = talk(rng, rng.randint(0, 200))
        parts = tt.leaves(text, 5)
        assert "".join(parts) == text
        assert sum(len(encode(p)) for p in parts) == len(encode(text))


@pytest.mark.parametrize("size", [1, 4, 30])
def test_edited_trees_count_as_whole_texts_do(size):
    encode, rng = encoder(), random.Random(size)
    for _ in range(60):
        text = talk(rng, rng.randint(0, 150))
        tree = tt.Tree(text, lambda t: len(encode(t)), size)
        for _ in range(12):
            a = rng.randint(0, len(text) + 1)
            b, new = a + rng.choice([0, 0, 1, 2, 9, 60]), talk(rng, rng.choice([0, 1, 2, 40]))
            tree.edit(a, b, new)
            a, b = min(a, len(text)), min(b, len(text))
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.chars[1] == len(text)
            assert tree.total == len(encode(text))


def test_small_edits_encode_little():
    encode = encoder()
    text = "all the words of a long and quiet story " * 5000
    tree = tt.Tree(text, lambda t: len(encode(t)))
    tree.encoded = 0
    for k in range(50):
        tree.edit(k * 3999, k * 3999 + 5, "seen")
    assert tree.encoded < 50 * 3 * tt.LEAF


def test_many_appends_and_insertions():
    count = lambda t: len(t.split(" "))
    tree = tt.Tree("a tale", count, 20)
    for k in range(100_000):
        tree.edit(10**9, 10**9, " word")
    assert tree.chars[1] == 6 + 500_000 and tree.encoded < 100_000 * 60
    for k in range(3000):
        tree.edit(250_000, 250_000, " and then some more")
    assert len(tree.text()) == tree.chars[1] == 6 + 500_000 + 3000 * 19


def test_rows_of_two_runs(spark):
    encode = encoder()
    long = "all the words of a long and quiet story " * 500
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "one two three", "x"), (4, long, "x")], "doc_id long, text string, edits string")
    state = tt.trees(docs)
    assert tt.revise(tt.revisions(state)).count() == 6
    schema = "doc_id long, seq int, start long, end long, text string"
    first = spark.createDataFrame([(1, 0, 0, 3, "1"), (1, 1, 100, 200, " four"), (9, 0, 0, 1, ""), (4, 0, 9000, 9003, "seen"), (4, 1, 2, 2, None)], schema)
    held = tt.revise(tt.with_edits(state, first)).collect()
    assert len(held) == 6 and [r["n_tokens"] for r in held if r["doc_id"] == 1] == [len(encode("1 two three four"))] * 2
    for r in held:
        assert r["n_tokens"] == sum(r["tokens"]) == len(encode(r["text"])) and sum(r["chars"]) == len(r["text"])
    again = spark.createDataFrame(held).select("doc_id", "text", "chars", "tokens")
    (four,) = tt.revise(tt.with_edits(again, spark.createDataFrame([(4, 0, 15000, 15009, "and")], schema))).where("doc_id = 4").collect()
    assert four["n_tokens"] == len(encode(four["text"])) and 0 < four["n_chars_encoded"] < 3 * tt.LEAF
    assert tt.revise(tt.revisions(state.limit(0))).collect() == []

"""Benchmark decontamination: every passage of the corpus queries a BM25 inverted index of the test items.

Impacts are BM25 weights divided by the score of the item against itself, so a score is the share of the item that a
passage holds, from 0 to 1, and one threshold serves all items. Block-max WAND retrieves all items at or above it. Each
is then verified: the item is cut into question (all but its last sentence) and answer, and the passage has to hold
enough of both: of their word n-grams, or, as one changed word breaks n of those, of their words when the item is
aligned with the passage. An answer of fewer than n words counts where it follows its question, or verbatim.

Passages are windows of 2 * L words every L words, so a copy of an item of up to L words lies within one of them. Items
are indexed by length class (L = 64, 128, ...) in order of length, in blocks of a few items. Block maxima lie in a matrix
of terms by blocks, so one sum over a passage's terms bounds its score in every block at once; WAND then runs with those
maxima in the blocks whose bound reaches the threshold, and in no other.

The index goes to executors in shards of bounded size, one after the other: shards are filled by hash, as many as the test
set's size asks for, and each sees all documents. Term statistics are those of the whole test set.

Null or empty texts match nothing. Items of fewer than `least_words` words are found where all their words stand in a
row. Repeated items (same id and text) count once. Rows come once per document id and item id.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.!?:]\s+")
FOUND = "item_id long, score double, question_overlap double, answer_overlap double"


@dataclass(frozen=True)
class Rules:
    """threshold: share of an item's BM25 weight that a passage has to hold. question, answer: shares of their n-grams,
    or of their words in line with the passage. least_words: items of fewer are found verbatim only. block, group: items to a block, and to a matrix of block maxima. shard_chars: text of the items sent at a time."""

    threshold: float = 0.6
    question: float = 0.6
    answer: float = 0.5
    n: int = 5
    least_words: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    group: int = 1024
    shard_chars: int = 2_000_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str], bool]:
    """The last sentence is the answer; a single sentence (then True) has its last quarter for one."""
    cuts = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
    head, tail = (text.strip()[: cuts[-1]], text.strip()[cuts[-1] :]) if cuts else (text, "")
    question, answer = words(head), words(tail)
    single = not question or not answer
    if single:
        every = question + answer
        at = len(every) - max(1, len(every) // 4)
        question, answer = every[:at], every[at:]
    return question, answer, single


def edits(part: list[int], passage: np.ndarray) -> list[int]:
    """For each beginning of the part, the fewest words to change, insert or remove to find it in the passage."""
    places = np.arange(len(passage) + 1)
    row, found = np.zeros(len(passage) + 1, dtype=np.int64), [0]
    for word in part:
        kept = np.minimum(row[:-1] + (passage != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate((row[:1] + 1, kept)) - places) + places
        found.append(int(row.min()))
    return found


class Index:
    """Up to `group` items of one length class: postings by term and block, and the block maxima of each term."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: dict[str, int], df: dict[str, int], n_items: int, mean: float, rules: Rules, window: int):
        self.rules, self.window = rules, window
        self.items: list[tuple[int, list[set[tuple[int, ...]]], list[int], list[list[int]], bool]] = []
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for item_id, text in items:
            question, answer, single = question_and_answer(text)
            counts: dict[str, int] = defaultdict(int)
            for w in question + answer:
                counts[w] += 1
            norm = rules.k1 * (1 - rules.b + rules.b * len(question + answer) / mean)
            weights = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (rules.k1 + 1) / (c + norm) for w, c in counts.items()}
            own = sum(weights.values())
            for w, x in weights.items():
                self.postings[vocabulary[w], len(self.items) // rules.block].append((len(self.items), x / own))
            grams, sizes, parts = [], [], []
            for part in (question, answer):
                ids = [vocabulary[w] for w in part]
                size = min(rules.n, len(ids))
                grams.append({tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)} if ids else set())
                sizes.append(size)
                parts.append(ids)
            self.items.append((item_id, grams, sizes, parts, single))
        terms = sorted({t for t, _ in self.postings})
        #: Row of each term in the maxima; row 0 is for terms that no item here has, and for -1.
        self.row = np.zeros(len(vocabulary) + 1, dtype=np.int32)
        self.row[terms] = np.arange(1, len(terms) + 1)
        self.maxima = np.zeros((len(terms) + 1, -(-len(items) // rules.block)), dtype=np.float32)
        for (term, block), pairs in self.postings.items():
            self.maxima[self.row[term], block] = max(x for _, x in pairs)

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items (by place) whose score with these different terms reaches the threshold."""
        bounds = self.maxima[self.row[terms]].sum(axis=0)
        live = np.nonzero(bounds >= self.rules.threshold - 1e-4)[0]
        return [x for block in live.tolist() for x in self._wand(terms.tolist(), block)] if len(live) else []

    def _wand(self, terms: list[int], block: int) -> Iterator[tuple[int, float]]:
        need = self.rules.threshold - 1e-9
        lists = [x for t in terms if (x := self.postings.get((t, block)))]
        cursors = [[x[0][0], 0, x, max(y for _, y in x)] for x in lists]  # item, place, postings, their maximum

        def to(cursor: list, item: int) -> None:
            at = cursor[1]
            while at < len(cursor[2]) and cursor[2][at][0] < item:
                at += 1
            cursor[0], cursor[1] = cursor[2][at][0] if at < len(cursor[2]) else math.inf, at

        while cursors:
            cursors.sort(key=lambda c: c[0])
            while cursors and cursors[-1][0] == math.inf:
                cursors.pop()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= need:
                    pivot = c[0]
                    break
            if pivot is None:
                return
            if cursors[0][0] == pivot:
                score = sum(c[2][c[1]][1] for c in cursors if c[0] == pivot)
                if score >= need:
                    yield pivot, score
                pivot += 1
            for c in cursors:
                if c[0] < pivot:
                    to(c, pivot)

    def verify(self, place: int, ids: list[int]) -> tuple[float, float]:
        """Shares of the question and of the answer that the passage holds: of n-grams, or of aligned words if those are
        too few."""
        shares = []
        for grams, size in zip(self.items[place][1], self.items[place][2], strict=True):
            held = set(zip(*(ids[k:] for k in range(size)), strict=False)) if size else set()
            shares.append(len(grams & held) / len(grams) if grams else 1.0)
        if shares[0] >= self.rules.question and shares[1] >= self.rules.answer:
            return shares[0], shares[1]
        (question, answer), single = self.items[place][3:]
        passage = np.asarray(ids)
        needed = edits(question + answer, passage)
        if single and needed[-1] <= 1:
            # The answer was cut from a sentence: one edit to the sentence may lie anywhere in it.
            return (1 - needed[-1] / (len(needed) - 1),) * 2
        asked = needed[len(question)]
        shares[0] = max(shares[0], 1 - asked / max(1, len(question)))
        shares[1] = max(shares[1], 1 - (needed[-1] - asked) / max(1, len(answer)))
        if len(answer) >= self.rules.n and shares[1] < self.rules.answer and shares[0] >= self.rules.question:
            shares[1] = max(shares[1], 1 - edits(answer, passage)[-1] / len(answer))
        return shares[0], shares[1]

    def matches(self, ids: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """item_id to (score, question share, answer share) of a document given as term numbers (-1: in no item)."""
        found: dict[int, tuple[float, float, float]] = {}
        for a in range(0, max(1, len(ids) - self.window), self.window):
            part = ids[a : a + 2 * self.window]
            for place, score in self.retrieve(np.unique(part)):
                question, answer = self.verify(place, part.tolist())
                if question >= self.rules.question and answer >= self.rules.answer:
                    item_id = self.items[place][0]
                    found[item_id] = max(found.get(item_id, (0.0, 0.0, 0.0)), (score, question, answer))
        return found


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}"


def _shard(docs: DataFrame, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean: float, rules: Rules) -> tuple[DataFrame, Broadcast]:
    vocabulary = {w: k for k, w in enumerate(df)}
    classes: dict[int, list[tuple[int, str]]] = defaultdict(list)
    short: dict[int, dict[tuple[int, ...], list[int]]] = {}
    for item_id, text in sorted(items):
        n = len(words(text))
        if n < rules.least_words:
            short.setdefault(n, defaultdict(list))[tuple(vocabulary[w] for w in words(text))].append(item_id)
            continue
        classes[max(64, 1 << (n - 1).bit_length())].append((item_id, text))
    indexes = []
    for window, held in sorted(classes.items()):
        held.sort(key=lambda x: (len(words(x[1])), x))
        indexes += [Index(held[k : k + rules.group], vocabulary, df, n_items, mean, rules, window) for k in range(0, len(held), rules.group)]
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, indexes, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, indexes, short = sent.value
        for batch in batches:
            rows: list[tuple[int, int, float, float, float]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                ids = np.fromiter(map(vocabulary.get, found, repeat(-1)), dtype=np.int32, count=len(found))
                for index in indexes:
                    rows += [(doc_id, item, *shares) for item, shares in index.matches(ids).items()]
                for n, held in short.items():
                    run_of = ids.tolist()
                    rows += [(doc_id, item, 1.0, 1.0, 1.0) for x in held.keys() & set(zip(*(run_of[k:] for k in range(n)), strict=False)) for item in held[x]]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (batch.column(0).type, pa.int64(), *[pa.float64()] * 3), strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(run, _schema(docs)), sent


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the items that a document leaks, with its best passage."""
    return leaks(common.texts(docs), benchmark, rules)


def leaks(whole: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """contaminated(), of rows (doc_id, of any type; text) without null texts."""
    spark = whole.sparkSession
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["item_id", "text", "words"])

    items = items.mapInArrow(split, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    items = common.stored(items, "items")
    sizes = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.length("text")).alias("chars")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], _schema(whole))
    terms = common.stored(items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count(), "item-terms")
    shards = -(-sizes["chars"] // rules.shard_chars)
    parts = []
    for k in range(shards):
        # Bounded by shard_chars: the shard's items, and the counts of the terms in them.
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        held = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()]
        named = own.select(F.explode("words").alias("term")).distinct()
        df = {r["term"]: r["count"] for r in terms.join(named, "term", "left_semi").orderBy("term").collect()}
        if held:
            found, sent = _shard(whole, held, df, sizes["n"], sizes["mean"], rules)
            if shards > 1:  # its index leaves the executors before the next one comes
                found = common.stored(found, "leaks")
                sent.destroy()
            parts.append(found)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return every.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

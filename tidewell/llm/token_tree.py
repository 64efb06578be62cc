"""Edit-aware token counts: a segment tree of pre-token runs for each document.

Byte-level BPE never merges across pre-tokens, and a blank between two letters always begins one. A text is cut at such
blanks into leaves of some hundred characters, each with its token count; the tree above holds sums of characters and
tokens. An edit finds its leaves by character offset in logarithmic time, widens to the next leaf where it touches the
characters that make a cut valid, re-encodes that region alone, and updates the sums above it. Leaves that a region needs
beyond its own go to empty places behind it; if there are none, the tree is laid out anew with room behind every leaf, without
encoding anything again.

Trees are kept: trees() gives a table of texts with the sums of their leaves, and revise() applies edits to such a table
and gives the next one, so a later run encodes what its own edits touch and no more.

Null texts count as empty and have no token. Edits are (start, end, text) in code points of the text as it is when
their turn comes; offsets beyond the end mean the end, a reversed range is an insertion at its start, null edits and
null replacement texts are an empty list and an empty text. Each row gets a row; repeated rows of an id have all its edits.
Columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.tokenizer import encoder

LEAF = 512
_GAP = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces that are encoded independently, of at least `size` characters but for the last."""
    out, at = [], 0
    while True:
        m = _GAP.search(text, at + size)
        while m and not (text[m.start() - 1].isalpha() and text[m.end()].isalpha()):
            m = _GAP.search(text, m.end())
        if not m:
            return [*out, text[at:]] if text[at:] or not out else out
        out.append(text[at : m.start()])
        at = m.start()


class Tree:
    """Sums of characters and tokens over leaves. sums: characters and tokens of the leaves of the text, where they are
    known; otherwise it is cut and encoded."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = LEAF, sums: tuple[list[int], list[int]] | None = None):
        self.count, self.size = count, size
        self.encoded = 0
        if sums is None:
            self._lay([(x, self._encode(x)) for x in leaves(text, size)])
        else:
            ends = [0, *accumulate(sums[0])]
            self._lay([(text[a:b], n) for a, b, n in zip(ends, ends[1:], sums[1], strict=False)])

    def _lay(self, parts: list[tuple[str, int]], apart: int = 1) -> None:
        self.width = 1
        while self.width < len(parts) * apart:
            self.width *= 2
        self.held = [""] * self.width
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (text, tokens) in enumerate(parts):
            self.held[k * apart] = text
            self.chars[self.width + k * apart], self.tokens[self.width + k * apart] = len(text), tokens
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    def _sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _put(self, k: int, text: str, tokens: int) -> None:
        self.held[k] = text
        at = self.width + k
        self.chars[at], self.tokens[at] = len(text), tokens
        while at := at >> 1:
            self._sum(at)

    def parts(self, a: int = 0, b: int | None = None) -> list[tuple[str, int]]:
        """The leaves in these places, empty ones excepted, and their tokens."""
        return [(self.held[k], self.tokens[self.width + k]) for k in range(a, self.width if b is None else b) if self.held[k]]

    def _find(self, offset: int) -> tuple[int, int]:
        """The leaf of a character (or the last one that has any), and where it begins."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if offset - begin >= self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.width, begin

    def text(self) -> str:
        return "".join(self.held)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def edit(self, start: int, end: int, new: str) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, begin = self._find(start)
        # A cut needs the two characters behind it and the one before it: an edit there takes in the next leaf.
        while start - begin < 2 and begin > 0:
            first, begin = self._find(begin - 1)
        last, at = self._find(max(start, end - 1))
        stop = at + self.chars[self.width + last]
        while stop - end < 1 and stop < n:
            last, at = self._find(stop)
            stop = at + self.chars[self.width + last]
        region = "".join(self.held[first : last + 1])
        region = region[: start - begin] + new + region[end - begin :]
        parts = [(x, self._encode(x)) for x in leaves(region, self.size)]
        while len(parts) > last - first + 1 and last + 1 < self.width and not self.held[last + 1]:
            last += 1
        if len(parts) > last - first + 1:
            self._lay([*self.parts(0, first), *parts, *self.parts(last + 1)], 2)
            return
        for k in range(last - first + 1):
            self._put(first + k, *(parts[k] if k < len(parts) else ("", 0)))


TREE = "doc_id long, text string, chars array<int>, tokens array<int>"


def _state(ids: pa.Array, trees: list[Tree]) -> list[pa.Array]:
    held = [t.parts() for t in trees]
    ints = pa.list_(pa.int32())
    return [ids, pa.array([t.text() for t in trees], pa.string()), pa.array([[len(x) for x, _ in p] for p in held], ints), pa.array([[n for _, n in p] for p in held], ints)]


def trees(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, text, and the characters and tokens of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            held = [Tree(x.as_py(), lambda t: len(encode(t)), leaf) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(_state(batch.column(0), held), ["doc_id", "text", "chars", "tokens"])

    return common.texts(docs).mapInArrow(run, TREE)


def revise(state: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The table after its column `edits` (array of start, end, text): doc_id, text, chars, tokens as trees() gives them,
    n_tokens and n_tokens_before, and n_chars_encoded, of which the counts took note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            held, before = [], []
            for text, chars, tokens, edits in zip(batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                tree = Tree(text.as_py(), lambda t: len(encode(t)), leaf, (chars.as_py(), tokens.as_py()))
                before.append(tree.total)
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                held.append(tree)
            counts = ([t.total for t in held], before, [t.encoded for t in held])
            yield pa.RecordBatch.from_arrays([*_state(batch.column(0), held), *(pa.array(x, pa.int64()) for x in counts)], ["doc_id", "text", "chars", "tokens", "n_tokens", "n_tokens_before", "n_chars_encoded"])

    asked = common.bounded(state).select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS))
    return asked.mapInArrow(run, f"{TREE}, n_tokens long, n_tokens_before long, n_chars_encoded long")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """A table of trees with the column `edits` made of rows (doc_id, seq, start, end, text), in order of seq."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("x"))
    lists = lists.select("doc_id", F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))
    return state.select("doc_id", "text", "chars", "tokens").join(lists, "doc_id", "left")


def revisions(state: DataFrame) -> DataFrame:
    """A table of trees with three edits of every document at places that its id and length give: a deletion, an insertion, a replacement."""
    n = F.length("text").cast("long")
    place = lambda k: F.pmod(F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(k)).cast("binary")), n + 1)
    edit = lambda a, size, text: F.struct(a.alias("start"), (a + size).alias("end"), F.lit(text).alias("text"))
    return state.withColumn("edits", F.array(edit(place(1), 9, ""), edit(place(2), 0, " a remark"), edit(place(3), 12, "[revised]")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = common.stored(trees(common.table(spark, sf_dir, "documents")), "trees")
    now = revise(revisions(state))
    return now.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), F.col("n_chars_encoded"))

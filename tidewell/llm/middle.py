"""Fill-in-middle transformation of whole texts by one numpy kernel a batch over Arrow's UTF-8 buffers.

The kernel never looks at one text at a time. A table of 256 entries turns each byte into its class; a second table says,
for the classes of a byte and of the byte before it, whether a unit begins there; a running sum of those beginnings, reset
at each text by what it is where the text starts, numbers the units; and one searchsorted over the sum finds the bytes of
both cuts of all texts. The pieces are then copied to their places in one gather. Hashes, form and the way back are Spark
expressions; nothing is shuffled.

A unit is a character (code point, the default) or a word with the white space behind it (a text's first unit also has
what stands before its first word). Cuts, form and order of a text follow from its doc_id and the seed alone, so a lost task
or another partitioning gives the same rows.

Edges: a null text counts as empty and is plain; a null doc_id counts as the empty string; repeated rows give repeated rows; texts that
hold a marker stay plain; other columns are left out; an empty table gives none. A very long text is a batch of its own, at about
seven bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), dtype=np.uint8)
#: Bytes of text that the kernel takes at a time; a longer text goes alone. Pieces of more than LONG bytes are copied as they are.
BYTES, LONG = 4 << 20, 1 << 15

#: Classes of bytes: white space of ASCII, other ASCII, first bytes of longer characters, their further bytes. NONE stands before a text.
SPACE, PLAIN, LEAD, MORE, NONE = range(5)
CLASS = np.full(256, PLAIN, dtype=np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[0x80:0xC0] = MORE
CLASS[0xC0:] = LEAD


def _boundaries(unit: str) -> np.ndarray:
    """Whether a unit begins at a byte, by 5 * (class of the byte before) + class."""
    begins = np.zeros((5, 5), dtype=bool)
    if unit == "character":
        begins[:, [SPACE, PLAIN, LEAD]] = True
    elif unit == "word":
        begins[SPACE, [PLAIN, LEAD]] = True
    else:
        raise ValueError("unit must be character or word")
    begins[NONE] = True
    return begins.ravel()


@dataclass(frozen=True)
class Rule:
    """How texts are cut: the seed of the draws, texts of a hundred that stay as they are, and of the others those of a hundred
    whose suffix comes first."""

    seed: int = 1
    plain_percent: int = 10
    suffix_first_percent: int = 20
    unit: str = "character"


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The running sum of units over all bytes, and of each text the sum before it and its number of units."""
    kind = CLASS[data]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    filled = starts < ends
    before[starts[filled]] = NONE
    before *= 5
    before += kind
    total = np.cumsum(begins[before], dtype=np.int32)
    reached = lambda at: np.where(at > 0, total[np.maximum(at, 1) - 1], 0).astype(np.int64) if len(total) else np.zeros(len(at), np.int64)
    base = reached(starts)
    return total, base, reached(ends) - base


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of the source one after the other."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    places = ends - lengths
    for k in np.flatnonzero(lengths > LONG):
        out[places[k] : ends[k]] = source[starts[k] : starts[k] + lengths[k]]
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    if len(short):
        size = lengths[short]
        step = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(places[short], size) + step] = source[np.repeat(starts[short], size) + step]
    return out


def transformed(text: pa.Array, draws: np.ndarray, shuffled: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    """n, form, the units of prefix and middle and the output of every text. draws: two a text; shuffled: 0 plain, 1 psm, 2 spm,
    before markers are looked for."""
    text = text.cast(pa.large_string())
    held = text.buffers()
    at = np.frombuffer(held[1], dtype=np.int64, count=len(text) + 1, offset=text.offset * 8) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(held[2] or b"", dtype=np.uint8)[int(at[0]) : int(at[-1])]
    at = at - at[0]
    starts, ends = at[:-1], at[1:]
    total, base, n = units(data, starts, ends, begins)
    # A marker within a text: four bytes would tell no more than "<", one of three letters, ">".
    open_ = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    marked = open_[np.isin(data[open_ + 1], np.frombuffer(b"PSM", np.uint8)) & (data[open_ + 2] == ord(">"))]
    inside = np.searchsorted(marked, ends - 2) > np.searchsorted(marked, starts)
    form = np.where((starts == ends) | inside, 0, shuffled)
    cuts = np.sort(draws % (n[:, None] + 1), axis=1)
    # The first byte whose sum goes past base + k begins unit k; past the last unit that is where the text ends.
    low, high = (np.where(cuts[:, k] >= n, ends, np.searchsorted(total, base + cuts[:, k], side="right")) for k in (0, 1))
    plain, psm = form == 0, form == 1
    # Up to six pieces a text: mark, piece, mark, piece, mark, piece. Plain texts are one piece.
    marks = len(data) + np.array([[0, 3, 6], [3, 0, 6]])[np.where(psm, 0, 1)]
    first, second = (np.where(psm, starts, high), np.where(psm, low, ends)), (np.where(psm, high, starts), np.where(psm, ends, low))
    pieces = np.stack([marks[:, 0], np.where(plain, starts, first[0]), marks[:, 1], second[0], marks[:, 2], low], axis=1)
    sizes = np.stack([np.full(len(n), 3), np.where(plain, ends - starts, first[1] - first[0]), np.full(len(n), 3), second[1] - second[0], np.full(len(n), 3), high - low], axis=1)
    sizes[plain] *= np.array([0, 1, 0, 0, 0, 0])
    out = gathered(np.concatenate([data, MARKS]), pieces.ravel(), sizes.ravel())
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int64)
    output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())
    none = pa.array(plain)
    count = lambda x: pc.if_else(none, None, pa.array(x, pa.int64()))
    names = pa.DictionaryArray.from_arrays(pa.array(form, pa.int8()), ["plain", "psm", "spm"]).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), names, count(cuts[:, 0]), count(cuts[:, 1] - cuts[:, 0]), output], ["n", "form", "prefix_units", "middle_units", "output"])


def _slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of BYTES bytes at most, or of one."""
    size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BYTES, side="right")))
        yield a, b
        a = b


def _kernel(begins: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text")):
                part = batch.slice(a, b - a)
                draws = np.stack([part.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
                made = transformed(part.column("text"), draws, part.column("shuffled").to_numpy(), begins)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.columns], ["doc_id", *made.schema.names])

    return run


def transform(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units (null if plain) and output of every row of docs (doc_id, text)."""
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    drawn = common.texts(docs).withColumn("digest", digest)
    shuffled = F.when(draw(3) % 100 >= 100 - rule.plain_percent, 0).when(draw(4) % 100 < rule.suffix_first_percent, 2).otherwise(1)
    drawn = drawn.select("doc_id", "text", draw(1).alias("h1"), draw(2).alias("h2"), shuffled.cast("long").alias("shuffled"))
    return drawn.mapInArrow(_kernel(_boundaries(rule.unit)), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text, from the output and its form alone. Texts with markers are plain, so a marker in another output is one of its three."""
    psm, spm = F.split(output, f"{SUFFIX}|{MIDDLE}"), F.split(output, f"{PREFIX}|{MIDDLE}")
    bare = lambda x: F.substring(x, 4, 2**31 - 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(bare(psm[0]), psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], bare(spm[0])))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and digests of output and of the text made again from it, of every document."""
    out = transform(common.table(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
h as (
  select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""

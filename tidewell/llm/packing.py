"""Best-fit-decreasing packing of documents into fixed-length token sequences.

Documents become pieces in one pass over the texts. Best-fit decreasing looks at nothing but lengths, and there are
no more lengths than the capacity, so the plan is made on the driver from a histogram of at most ``capacity`` rows,
however large the corpus: a segment tree over remaining capacities finds the tightest open bin in logarithmic time,
and a run of equal lengths goes into a run of equal bins in one step, with the outcome of placing them one by one.
Executors then rank the pieces of a length (salted, so that no length is one task) and look their place up.

Null texts count as empty and give one piece of length 1 (the end marker). An empty table gives no rows. Repeated
rows are packed as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.tokenizer import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids, then end_id; only longer ones are cut, the remainder comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[a:b]
                    for column, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(part.tobytes()), part if with_ids else None), strict=True):
                        column.append(x)
                held += n
                if with_ids and held > 4_000_000:
                    yield made(out)
                    out, held = [[], [], [], [], [], []], 0
            yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in out[5]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return common.texts(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Bins by remaining capacity; a segment tree tells the least capacity of at least x that has a bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def put(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.runs[room].append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def _mark(self, room: int, on: bool) -> None:
        i = room + self.size
        self.tree[i] = on
        while i := i >> 1:
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        while not self.tree[i]:
            while i & 1:  # a right child: nothing further right under this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}. Rows (length, first rank, first bin, pieces a bin, offset): the pieces
    of a length, by rank, fill bins in order, so many a bin, one behind the other from the offset."""
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(room)
            # The tightest bin stays the tightest until no more fits, so a bin is filled before the next is begun.
            each = room // length
            full, rest = divmod(min(left, each * count), each)
            rows.append((length, rank, first, each, capacity - room))
            bins.put(room - each * length, first, full)
            bins.put(room - rest * length, first + full, 1 if rest else 0)
            bins.put(room, first + full + bool(rest), count - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return rows


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces. It is read twice, so it has to be the same rows each time."""
    counts = found.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in counts.collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    salts = max(64, sum(histogram.values()) >> 22)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(within)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    arrays = [np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)] or [np.zeros(0, np.int64)] * 5

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, bins, each, offsets = arrays
        starts = lengths * (1 << 44) + firsts
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            nth = rank - firsts[k]
            keep = [x for x in batch.schema.names if x not in ("salt", "rank", "base", "n")]
            columns = [batch.column(batch.schema.get_field_index(x)) for x in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins[k] + nth // each[k]), pa.array(offsets[k] + nth % each[k] * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("salt", "rank", "base", "n").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Sequences of at most `capacity` tokens: one row per piece with its place. with_ids adds the ids themselves."""
    found = common.stored(pieces(docs, capacity, end_id, tokenizer, with_ids), "pieces")
    return place(found, capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Exact n-gram Jaccard join with a size-aware split into small and large sets, and the components of its links.

Documents with equal shingle sets are one node, named by a hash of the set. Two nodes of sizes s and t link when they
share at least c = ceil(3 (s + t) / 7) shingles, that is, when their Jaccard similarity is at least 0.75.

*Small sets* (up to a boundary) enumerate, for each partner size t up to the boundary, all their subsets of size c. Two
small sets link exactly if they have such a subset in common, so a shared subset (told by 128 bits) needs no verification.
*Large sets* scan inverted lists. Shingles are ordered by hash, frequent ones last, rarest first; linked sets share one
of their first s - ceil(3 s / 4) + 1 shingles, so only those are posted, by all sets that can link with a large one. Pairs
of a list with at least one large set are verified against the whole sets. The boundary is where the bytes that enumerated
subsets move, plus those that the lists of the other sets and the pairs in them move, are least.

Before sets are compared, a bitmap of each (four to eight bits a shingle) bounds their overlap: a bit that only one of them
has stands for a shingle that the other lacks. Only pairs that may reach the overlap they need are compared, and only the
sets of those are made again from the texts: bitmaps are stored, whole sets never for longer than one comparison.

No list is expanded into all its pairs. Lists of up to `paired` sets give their pairs; longer ones first give a star around
one of their sets, and links become components. Of a list that still has several components, the sets outside its largest
one meet the others in cells of bounded size: first few sets of each cell, then all of them. Every pair of a list is thus
verified, ruled out by its sizes, places or bitmaps, or already connected, so the components are exact. Lists that are expected to be
very long are dealt to several tasks, and cells are drawn over all of their parts. Which shingles count as frequent only
decides the order, and any order is exact.

Names have 64 bits. A second hash tells names that different sets share (of N sets, N**2 / 2**65 are to be expected, 3
of 1e10); the sets with those names go by the second hash.

Null, empty and blank texts have the empty set and link with nothing. Rows of one id count as one document if their sets
are equal, otherwise each row keeps its own set, and the id goes with the set. Null ids link as any other and never name a
component of others. Each row gets a row; columns other than doc_id and text are left alone.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.components import components, merged
from tidewell.llm.shingles import mix, names_of, shingle_sets

#: Pairs or nodes of 16 bytes up to which they go to all executors; more of them are shuffled.
FEW_PAIRS = 200_000

#: Bytes of a shuffled key of a subset, posted shingle or pair, and of a shingle of a set that is moved with its bitmap.
ROW_BYTES, SHINGLE_BYTES = 32, 9


@dataclass(frozen=True)
class Limits:
    """most_keys: subsets that a small set may be enumerated into, which rules out boundaries beyond. frequent: places in
    the order given to frequent shingles, 16 bytes each. counted: shingles that a task counts together; seen: how often one
    has to occur among them to be reported. paired: sets of a list up to which all its pairs are candidates at once.
    list_rows: posted shingles to a task. split: sets to a part of a list that is expected to be longer. block: sets to a
    side of a cell; hubs: those that are tried first. known: names that a task remembers. filter_bits: of the filters of
    nodes and texts that are needed. name_bits: of a set's name."""

    size: int = 5
    most_keys: int = 1 << 14
    frequent: int = 1 << 19
    counted: int = 3_000_000
    seen: int = 2
    paired: int = 8
    list_rows: int = 1_500_000
    split: int = 200_000
    block: int = 256
    hubs: int = 64
    known: int = 200_000
    filter_bits: int = 1 << 25
    name_bits: int = 64


def needed(s: int, t: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-3 * (s + t) // 7)


def prefix(s: int) -> int:
    return s - (3 * s + 3) // 4 + 1


def partners(s: int, boundary: int) -> list[int]:
    """Sizes up to the boundary that a different set may have to link with one of size s."""
    return [t for t in range(-(-3 * s // 4), min(boundary, 4 * s // 3) + 1) if t >= 1 and needed(s, t) <= min(s, t) and (t != s or needed(s, t) < s)]


def keys_of(s: int, boundary: int) -> int:
    """How many subsets a set of size s enumerates."""
    return sum(comb(s, needed(s, t)) for t in partners(s, boundary))


@functools.cache
def most_small(most_keys: int) -> int:
    """The largest boundary at which no set has more keys than that."""
    b = 2
    while max(keys_of(s, b + 1) for s in range(1, b + 2)) <= most_keys:
        b += 1
    return b


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of any total length as one list array."""
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int64()), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(*v) for v in columns.values()], list(columns))


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each value of the low bits of the shingles; at least 4 bits a shingle, a power of two."""
    size = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    held = np.zeros(size, dtype=np.uint8)
    held[(shingles & np.uint64(size - 1)).astype(np.intp)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def may_link(n1: int, bits1: bytes, n2: int, bits2: bytes) -> bool:
    """Whether bitmaps of sets of those sizes leave room for the overlap of a link."""
    if len(bits1) > len(bits2):
        n1, bits1, n2, bits2 = n2, bits2, n1, bits1
    x, y, size = int.from_bytes(bits1, "little"), int.from_bytes(bits2, "little"), 4 * len(bits2)
    while 2 * size > 8 * len(bits1):  # fold the longer one
        y, size = (y | (y >> size)) & ((1 << size) - 1), size // 2
    return min(n1 - (x & ~y).bit_count(), n2 - (y & ~x).bit_count()) >= needed(n1, n2)


class Naming:
    """Names of sets, without the names that different sets share."""

    def __init__(self, limits: Limits, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = limits.name_bits, shared

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        name, check = names_of(shingles)
        return name >> (64 - self.bits), check

    def __call__(self, shingles: np.ndarray) -> int:
        name, check = self.both(shingles)
        return check if name in self.shared else name

    def column(self):
        return F.when(F.col("node").isin(list(self.shared)), F.col("other")).otherwise(F.col("node")) if self.shared else F.col("node")


def _new(known: set[int], name: int, most: int) -> bool:
    """Whether a task does not remember the name; it forgets all when they are too many."""
    if name in known:
        return False
    if len(known) >= most:
        known.clear()
    known.add(name)
    return True


def survey(whole: DataFrame, limits: Limits) -> DataFrame:
    """A row for each document (doc_id, n, node, other, hash of its text, and its set if it may be small) and rows (shingle,
    seen) for frequent shingles. whole: doc_id, text, text_key."""
    kind = whole.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n int, node long, other long, text_key long, small array<long>, shingle long, seen long"
    largest, naming = most_small(limits.most_keys), Naming(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        known: set[int] = set()
        held, ids = 0, pa.int64()

        def frequent() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            keep = times >= limits.seen
            found, times = found[keep].view(np.int64), times[keep]
            n = len(found)
            return _batch({"doc_id": pa.nulls(n, ids), "n": pa.nulls(n, pa.int32()), "node": pa.nulls(n, pa.int64()), "other": pa.nulls(n, pa.int64()), "text_key": pa.nulls(n, pa.int64()), "small": pa.nulls(n, pa.list_(pa.int64())), "shingle": pa.array(found), "seen": pa.array(times, pa.int64())})

        for batch in batches:
            sets, ids = shingle_sets(batch.column(1).to_pylist(), limits.size), batch.column(0).type
            names = [naming.both(s) if len(s) else (None, None) for s in sets]
            small = [s.view(np.int64) if 0 < len(s) <= largest else None for s in sets]
            n = len(sets)
            yield _batch({"doc_id": batch.column(0), "n": ([len(s) for s in sets], pa.int32()), "node": ([a for a, _ in names], pa.int64()), "other": ([b for _, b in names], pa.int64()), "text_key": batch.column(2), "small": (small, pa.list_(pa.int64())), "shingle": pa.nulls(n, pa.int64()), "seen": pa.nulls(n, pa.int64())})
            for (name, _), s in zip(names, sets, strict=True):
                if name is not None and _new(known, name, limits.known):
                    waiting.append(s)
                    held += len(s)
            if held > limits.counted:
                yield frequent()
                waiting, held = [], 0
                known.clear()
        if waiting:
            yield frequent()

    return whole.mapInArrow(run, schema)


class Order:
    """Rank of shingles as 64-bit keys: by hash, frequent ones behind all others by how often they were seen."""

    def __init__(self, shingles: np.ndarray, seen: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.seen = shingles[order], seen[order]

    def times(self, sets: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(sets), dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.shingles, sets), len(self.shingles) - 1)
        return np.where(self.shingles[at] == sets, self.seen[at], np.uint64(0))

    def first(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the shingles that the set posts, in order, and how often they were seen."""
        times = np.minimum(self.times(sets), np.uint64(0x7FFFFFFF))
        keys = np.where(times == 0, sets >> np.uint64(1), np.uint64(1 << 63) | (times << np.uint64(32)) | (mix(sets) & np.uint64(0xFFFFFFFF)))
        order = np.argsort(keys)[: prefix(len(sets))]
        return keys[order], times[order]


@functools.cache
def _left_out(s: int, c: int) -> np.ndarray:
    """All choices of the s - c elements that a subset of size c lacks."""
    return np.array(list(combinations(range(s), s - c)), dtype=np.intp).reshape(comb(s, c), s - c)


def subsets(sets: np.ndarray, boundary: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sets of one size (rows of a matrix) and each partner size t: t, and two hashes of each subset by which a link
    with a set of size t is found; the pair of sizes is part of the hashes."""
    s = sets.shape[1]
    for t in partners(s, boundary):
        out, sizes = _left_out(s, needed(s, t)), np.uint64(min(s, t) << 32 | max(s, t))
        hashes = []
        for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            own = mix(sets ^ salt)
            hashes.append(mix((own.sum(axis=1, dtype=np.uint64)[:, None] - own[:, out].sum(axis=2, dtype=np.uint64)) ^ mix(np.array([sizes + salt]))))
        yield t, hashes[0], hashes[1]


def boundary_by_cost(small: DataFrame, sent, limits: Limits) -> int:
    """The size up to which sets enumerate subsets: the cheapest, by the bytes of their keys plus those of the shingles
    that the others post and of the sets and bitmaps of pairs in their lists. small: the different sets that may be small.
    sent: the broadcast Order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for x in batch.column(0):
                s = x.values.to_numpy().view(np.uint64)
                own = sums.setdefault(len(s), [0, 0])
                own[0] += 1
                own[1] += min(max(int(sent.value.first(s)[1].max()) - 1, 0), limits.paired)
        yield _batch({"n": (list(sums), pa.int32()), "sets": ([x[0] for x in sums.values()], pa.int64()), "met": ([x[1] for x in sums.values()], pa.int64())})

    rows = small.select("small").mapInArrow(run, "n int, sets long, met long").groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("met").alias("met")).collect()
    return cheapest({r["n"]: (r["sets"], r["met"]) for r in rows}, most_small(limits.most_keys))


def cheapest(sizes: dict[int, tuple[int, int]], largest: int) -> int:
    """sizes: how many sets there are of each size, and how many others they meet in their longest lists. A pair is met
    from both sides; it passes four joins, with its two sets and their bitmaps."""

    def cost(b: int) -> int:
        total = 0
        for n, (sets, met) in sizes.items():
            if n <= b:
                total += sets * keys_of(n, b) * ROW_BYTES
            if 4 * n // 3 > b:  # may link with a large set, and so is posted
                total += sets * prefix(n) * ROW_BYTES + met * (2 * ROW_BYTES + n * SHINGLE_BYTES)
        return total

    return min(range(largest + 1), key=lambda b: (cost(b), b))


def subset_links(small: DataFrame, boundary: int) -> DataFrame:
    """Links among small sets, by shared subsets: each set of one size with one of the other, which connects them all."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            node, sets = batch.column(0).to_numpy(), batch.column(1)
            for s in np.unique(size[size <= boundary]).tolist():
                own = np.nonzero(size == s)[0]
                most = max(1, limits_rows // max(1, keys_of(s, boundary)))
                for at in range(0, len(own), most):
                    part = own[at : at + most]
                    for t, key, check in subsets(np.stack([sets[k].values.to_numpy() for k in part.tolist()]).view(np.uint64), boundary):
                        m = key.size
                        yield _batch({"key": (key.ravel().view(np.int64), pa.int64()), "check": (check.ravel().view(np.int64), pa.int64()), "node": (np.repeat(node[part], key.shape[1]), pa.int64()), "n": (np.full(m, s), pa.int32()), "t": (np.full(m, t), pa.int32())})

    limits_rows = 1 << 18
    keyed = small.mapInArrow(enumerate_, "key long, check long, node long, n int, t int")
    ends = keyed.groupBy("key", "check").agg(*(f(F.when(F.col("n") <= F.col("t") if low else F.col("n") >= F.col("t"), F.col("node"))).alias(c) for f, low, c in ((F.min, True, "low"), (F.min, False, "high"), (F.max, False, "last"))))
    ends = common.stored(ends.where("low is not null and high is not null and low <> last"), "subsets")
    # A set of one size links with every set of the other size that has the subset; with one size, all link with each other.
    own = keyed.join(ends, ["key", "check"]).select(F.when(F.col("n") < F.col("t"), F.col("high")).otherwise(F.col("low")).alias("b"), F.col("node").alias("a"))
    return own.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def posted(whole: DataFrame, sent, naming: Naming, boundary: int, limits: Limits) -> DataFrame:
    """salt, node, key, at_n: the posted shingles of each set that may link with a large one, once while a task remembers it.
    salt: the part of a list that is dealt to several tasks, otherwise -1. at_n: the shingle's place in the set's order, and
    the size of the set in the high half; rows of a set so differ in few bytes that follow each other, and compress well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            names, sizes, keys, times = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), limits.size):
                if len(s) and 4 * len(s) // 3 > boundary and _new(known, name := naming(s), limits.known):
                    names.append(name)
                    sizes.append(len(s))
                    own = sent.value.first(s)
                    keys.append(own[0])
                    times.append(own[1])
            if names:
                lengths = np.array([len(x) for x in keys])
                node, flat = np.repeat(np.array(names, np.int64), lengths), np.concatenate(keys).view(np.int64)
                parts = 1 + np.concatenate(times) // np.uint64(limits.split)
                salt = np.where(parts > 1, (mix(node.view(np.uint64)) % parts).astype(np.int64), -1)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at_n = at + (np.repeat(np.array(sizes, np.int64), lengths) << 32)
                whole = _batch({"salt": (salt, pa.int32()), "node": (node, pa.int64()), "key": (flat, pa.int64()), "at_n": (at_n, pa.int64())})
                yield from (whole.slice(k, 100_000) for k in range(0, whole.num_rows, 100_000))

    return whole.mapInArrow(run, "salt int, node long, key long, at_n long")


def _admitted(n1, at1, n2, at2):
    """Whether sizes and places of their first common shingle allow for a link."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    return (4 * low >= 3 * high) & (1 + np.minimum(n1 - 1 - at1, n2 - 1 - at2) >= -(-3 * (n1 + n2) // 7))


def _candidates(boundary: int, paired: int):
    """From the posted shingles of a partition: rows (a, b) of pairs, and rows (a, key, n, at) of the members of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for held, column in zip(columns, batch.columns, strict=True):
                held.append(column.to_numpy())
        if not columns[0]:
            return
        salt, node, key, at_n = (np.concatenate(x) for x in columns)
        del columns
        key, n, at = key.view(np.uint64), at_n >> 32, at_n & 0xFFFFFFFF
        order = np.lexsort((node, salt, key))
        key, salt, node, n, at = key[order], salt[order], node[order], n[order], at[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])])
        key, salt, node, n, at = key[fresh], salt[fresh], node[fresh], n[fresh], at[fresh]
        start = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))[0]
        size = np.diff(np.append(start, len(key)))
        first, second = [], []

        def pair(i: np.ndarray, j: np.ndarray) -> None:
            keep = _admitted(n[i], at[i], n[j], at[j]) & ((n[i] > boundary) | (n[j] > boundary))
            first.append(i[keep])
            second.append(j[keep])

        for m in range(2, paired + 1):
            of = start[(size == m) & (salt[start] < 0)]
            for x, y in combinations(range(m), 2):
                pair(of + x, of + y)
        long = (size > paired) | (salt[start] >= 0)
        member = np.nonzero(np.repeat(long, size))[0]
        pair(np.repeat(start[long], size[long]), member)
        i, j = np.concatenate(first), np.concatenate(second)
        pairs = np.unique(np.stack([node[i], node[j]], axis=1)[i != j], axis=0)
        for k in range(0, len(pairs), 100_000):
            part = pairs[k : k + 100_000]
            yield _batch({"a": (part[:, 0], pa.int64()), "b": (part[:, 1], pa.int64()), "key": pa.nulls(len(part), pa.int64()), "n": pa.nulls(len(part), pa.int32()), "at": pa.nulls(len(part), pa.int32())})
        # Of whole lists with the same members the first one does: places in it are the earliest.
        if len(member):
            sums = np.add.reduceat(mix(node[member].view(np.uint64)), np.concatenate([[0], np.cumsum(size[long])[:-1]]))
            same = np.stack([sums, size[long].astype(np.uint64), np.where(salt[start[long]] < 0, np.uint64(0), key[start[long]])], axis=1)
            once = np.zeros(len(sums), dtype=bool)
            once[np.unique(same, axis=0, return_index=True)[1]] = True
            member = member[np.repeat(once, size[long])]
        for k in range(0, len(member), 100_000):
            part = member[k : k + 100_000]
            yield _batch({"a": (node[part], pa.int64()), "b": pa.nulls(len(part), pa.int64()), "key": (key[part].view(np.int64), pa.int64()), "n": (n[part], pa.int32()), "at": (at[part], pa.int32())})

    return run


class Filter:
    """A Bloom filter of 64-bit hashes, of fixed size."""

    def __init__(self, bits: int):
        self.bits, self.bytes = np.uint64(bits), np.zeros(bits // 8, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes.view(np.uint64) % self.bits
        np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.intp), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) % self.bits
        return (self.bytes[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter_of(rows: DataFrame, bits: int, among: Filter | None = None) -> Filter:
    """A filter of the hashes in the columns of rows; with `among`, of those in the second column beside one in the first
    that it holds. One of fixed size a task, eight at most, united on the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(bits)
        for batch in batches:
            if sent is None:
                for column in batch.columns:
                    held.add(column.drop_null().to_numpy())
            else:
                held.add(batch.column(1).to_numpy()[sent.value.holds(batch.column(0).to_numpy())])
        yield _batch({"bits": ([zlib.compress(held.bytes.tobytes(), 1)], pa.binary())})

    sent = None if among is None else rows.sparkSession.sparkContext.broadcast(among)
    out = Filter(bits)
    for r in rows.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        out.bytes |= np.frombuffer(zlib.decompress(bytes(r["bits"])), dtype=np.uint8)
    if sent is not None:
        sent.destroy()
    return out


def sets_of(whole: DataFrame, named: DataFrame, wanted: DataFrame, naming: Naming, limits: Limits, whole_sets: bool) -> DataFrame:
    """row, node, n, and bits or shingles: bitmaps or whole sets of the wanted nodes (and of few others), once while a task
    remembers them. They go from the texts to the shared folder without a shuffle; a filter of the hashes of texts (from
    named: node, text_key) spares those of other nodes, so only wanted ones are split into shingles."""
    sc = whole.sparkSession.sparkContext
    nodes = _filter_of(wanted, limits.filter_bits)
    keys = _filter_of(named.where("node is not null").select("node", "text_key"), limits.filter_bits, nodes)
    sent = sc.broadcast((nodes, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys = sent.value
        known: set[int] = set()
        read: set[int] = set()
        for batch in batches:
            key = batch.column(0).to_numpy()
            of = [k for k in np.nonzero(keys.holds(key))[0].tolist() if _new(read, int(key[k]), limits.known)]
            sets = [s for s in shingle_sets(batch.column(1).take(pa.array(of, pa.int64())).to_pylist(), limits.size) if len(s)]
            names = np.array([naming(s) for s in sets], dtype=np.int64)
            keep = [k for k in np.nonzero(nodes.holds(names))[0].tolist() if _new(known, int(names[k]), limits.known)]
            sets = [sets[k] for k in keep]
            content = _lists(sets) if whole_sets else pa.array([bitmap(s) for s in sets], pa.binary())
            yield _batch({"node": (names[keep], pa.int64()), "n": ([len(s) for s in sets], pa.int32()), "shingles" if whole_sets else "bits": content})

    found = whole.select("text_key", "text").mapInArrow(run, f"node long, n int, {'shingles array<long>' if whole_sets else 'bits binary'}")
    out = common.stored(found.withColumn("row", F.monotonically_increasing_id()), "sets" if whole_sets else "maps")
    sent.destroy()
    return out


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(2, 6)]
        yield batch.select(["a", "b"]).filter(pa.array([may_link(*x) for x in zip(*columns, strict=True)], pa.bool_()))


def _few(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The rows stored, to be sent to all executors if they are few, and their number."""
    held, n = common.stored_rows(df, label)
    return F.broadcast(held) if n <= FEW_PAIRS else held, n


def verified(pairs: DataFrame, bits: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The different pairs (a, b) whose sets link, stored, and their number; sets (of the nodes in the columns of a table)
    are made, moved and compared only where the bitmaps leave it open."""

    few = _few(pairs.distinct(), "pairs")[0]

    def side(of: str) -> DataFrame:
        return few.join(bits.select(F.col("node").alias(of), *(F.col(c).alias(f"{c}_{of}") for c in ("n", "bits"))), of)

    met = side("a").join(side("b"), ["a", "b"])
    met = met.select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    left, n = _few(met.mapInArrow(_open, "a long, b long"), "open")
    if not n:
        return left, 0
    made = sets(left.select("a", "b"))
    # Tasks may have made the same set; one of them does.
    first, _ = _few(made.groupBy("node").agg(F.min("row").alias("row")), "open-rows")
    made = made.join(first.select("row"), "row", "left_semi")
    asked, _ = _few(left.select("a").distinct(), "open-firsts")
    of_a = common.stored(made.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")).join(asked, "a", "left_semi"), "open-sets")
    both = left.join(made.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b").join(of_a, "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    linked = both.where(F.lit(100) * shared >= F.lit(75) * (F.size("of_a") + F.size("of_b") - shared))
    out = common.stored_rows(linked.select("a", "b"), "links")
    common.discard(made, of_a)
    return out


class _Maps:
    """Bitmaps of some nodes as matrices, one for each size; a longer one folds to a shorter."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bits])
        self.row = np.zeros(len(bits), dtype=np.int64)
        self.matrix: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            own = np.nonzero(self.words == w)[0]
            self.row[own] = np.arange(len(own))
            self.matrix[w, w] = np.frombuffer(b"".join(bits[k] for k in own), dtype=np.uint64).reshape(-1, w)

    def folded(self, words: int, to: int) -> np.ndarray:
        if (words, to) not in self.matrix:
            longer = self.folded(words, 2 * to)
            self.matrix[words, to] = longer[:, :to] | longer[:, to:]
        return self.matrix[words, to]

    def most(self, i: int, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bounds of the overlap of node i with each of the nodes j."""
        out = np.zeros(len(j), dtype=np.int64)
        for w in np.unique(self.words[j]).tolist():
            of = self.words[j] == w
            own, to = j[of], min(w, int(self.words[i]))
            x, y = self.folded(int(self.words[i]), to)[self.row[i]], self.folded(w, to)[self.row[own]]
            lost = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            out[of] = np.minimum(n[i] - lost[0], n[own] - lost[1])
        return out


def _cell(boundary: int, hubs: int | None):
    """Pairs of a cell, of sets (side: outside the largest component) with members, that share a list, lie in different
    components and that sizes, places and bitmaps leave open. With hubs, the likeliest two of that many members for each of
    the sets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, n, component, side = (table.column(c).to_numpy() for c in ("node", "n", "c", "side"))
        n, lists = n.astype(np.int64), table.column("lists").chunk(0)
        maps = _Maps(table.column("bits").to_pylist())
        members = np.nonzero(~side)[0]
        if hubs is not None:
            members = members[np.argsort(mix(node[members].view(np.uint64)))[:hubs]]
        ends = lists.offsets.to_numpy()
        key, at = (x.to_numpy() for x in lists.values.flatten())
        length = np.diff(ends)
        # The members' entries by list: those of a list are a range.
        place = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in members.tolist()]) if len(members) else np.zeros(0, np.int64)
        order = np.argsort(key[place], kind="stable")
        of_key, of_at, of_member = key[place][order], at[place][order].astype(np.int64), np.repeat(members, length[members])[order]
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.nonzero(side)[0].tolist():
            mine = slice(ends[i], ends[i + 1])
            low, high = np.searchsorted(of_key, key[mine]), np.searchsorted(of_key, key[mine], side="right")
            entry = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            j, own = of_member[entry], np.repeat(at[mine].astype(np.int64), high - low)
            keep = (component[j] != component[i]) & ((n[j] > boundary) | (n[i] > boundary)) & _admitted(n[i], own, n[j], of_at[entry])
            j = np.unique(j[keep])
            if len(j):
                most = maps.most(i, j, n)
                keep = most >= -(-3 * (n[i] + n[j]) // 7)
                j, most = j[keep], most[keep]
                if hubs is not None:
                    j = j[np.argsort(-most / (n[i] + n[j]), kind="stable")[:2]]
                first.append(np.full(len(j), node[i]))
                second.append(node[j])
        a, b = np.concatenate(first), np.concatenate(second)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def across(lists: DataFrame, labels: DataFrame, bits: DataFrame, boundary: int, hubs: int | None, limits: Limits) -> tuple[DataFrame, DataFrame] | None:
    """Open pairs across components of the lists that have several, and those lists; nothing if there are none. Lists
    with the same largest component are a bundle; each set of it is a row with its places in the lists."""
    of = labels.select("node", F.col("component").alias("c"))
    held = common.stored(lists.join(of, "node", "left").select("key", "node", "n", "at", F.coalesce("c", "node").alias("c")), "lists")
    tops = held.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"))
    tops, n = common.stored_rows(tops.where("top.m < m").select("key", F.col("top.c").alias("bundle")), "open-lists")
    if not n:
        return None
    rows = held.join(tops, "key")
    nodes = common.stored(rows.groupBy("bundle", "node").agg(F.min("n").alias("n"), F.min("c").alias("c"), F.collect_list(F.struct("key", "at")).alias("lists")), "bundles")
    sizes = nodes.groupBy("bundle").agg(F.count("*").alias("m"), F.count_if(F.expr("c <> bundle")).alias("outside"))
    sizes = common.stored(sizes.select("bundle", *(F.ceil(F.col(c) / limits.block).alias(c) for c in ("m", "outside"))), "bundle-sizes")
    # Cells (i, j): members of the block i, and sets outside the largest component of the block j.
    asked, _ = _few(nodes.select("node").distinct(), "bundled")
    own = bits.select("node", "bits").join(asked, "node", "left_semi")
    of_bundle = nodes.join(sizes, "bundle").join(own, "node")
    kept = ["bundle", "node", "n", "c", "lists", "bits"]
    member = of_bundle.select(*kept, F.lit(False).alias("side"), F.pmod(F.xxhash64("node"), "m").alias("i"), F.explode(F.expr("sequence(0L, outside - 1)")).alias("j"))
    side = of_bundle.where("c <> bundle").select(*kept, F.lit(True).alias("side"), F.explode(F.expr("sequence(0L, m - 1)")).alias("i"), F.pmod(F.xxhash64("node"), "outside").alias("j"))
    return member.unionByName(side).groupBy("bundle", "i", "j").applyInArrow(_cell(boundary, hubs), "a long, b long"), rows.select("key", "node", "n", "at")


def _most_frequent(often: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen at least so often that no more than `most` of them are sent, and how often."""
    least, total = 1, 0
    for r in often.groupBy("seen").count().orderBy(F.desc("seen")).toLocalIterator():
        total += r["count"]
        if total > most:
            least = r["seen"] + 1
            break
    rows = often.where(F.col("seen") >= least).toArrow()
    return rows["shingle"].to_numpy().view(np.uint64), rows["seen"].to_numpy().astype(np.uint64)


def classes(whole: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, of any type; n, node) and labels (node, component) of the nodes that link with another one, from
    rows (doc_id, text) without null texts. Stored tables."""
    spark = whole.sparkSession
    whole = whole.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = common.stored(survey(whole, limits), "survey")
    rows = found.where(F.col("n").isNotNull())
    sizes = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("other").alias("low"), F.max("other").alias("high"))
    posts = F.sum(F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1).alias("posts")
    total = sizes.agg(posts, F.collect_set(F.when(F.col("low") != F.col("high"), F.col("node"))).alias("shared")).first()
    naming = Naming(limits, frozenset(total["shared"]))
    members = rows.select("doc_id", "n", naming.column().alias("node"))
    named = rows.select(naming.column().alias("node"), "text_key")
    often = found.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen"))
    often = common.stored(often, "often")
    order = spark.sparkContext.broadcast(Order(*_most_frequent(often, limits.frequent)))
    small = found.where(F.col("small").isNotNull()).select(naming.column().alias("node"), "small").dropDuplicates(["node"])
    small = common.stored(small, "small")
    boundary = boundary_by_cost(small, order, limits)
    linked = subset_links(small, boundary)

    # Pairs with a large set: inverted lists of the posted shingles.
    tasks = common.parts(spark, total["posts"] or 0, limits.list_rows)
    dealt = posted(whole, order, naming, boundary, limits).repartition(tasks, "key", "salt")
    drawn = common.stored(dealt.mapInArrow(_candidates(boundary, limits.paired), "a long, b long, key long, n int, at int"), "candidates")
    order.destroy()
    common.release(spark)
    maps = sets_of(whole, named, drawn.select("a", "b"), naming, limits, False)
    first = maps.groupBy("node").agg(F.min("row").alias("row"))
    bits = common.stored(maps.join(_few(first, "map-rows")[0].select("row"), "row", "left_semi").select("node", "n", "bits"), "bitmaps")
    common.discard(maps)

    def sets(nodes: DataFrame) -> DataFrame:
        return sets_of(whole, named, nodes, naming, limits, True)

    checked, _ = verified(drawn.where(F.col("b").isNotNull()).select("a", "b"), bits, sets)
    labels = components(linked.unionByName(checked))
    common.release(spark)

    # Long lists whose sets are not yet all connected.
    lists = drawn.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), "n", "at")
    for hubs in (limits.hubs, None):
        left = across(lists, labels, bits, boundary, hubs, limits)
        if left is None:
            break
        fresh, n = verified(left[0], bits, sets)
        labels, lists = merged(labels, fresh) if n else labels, left[1]
    common.discard(often, small, bits)
    common.release(spark)
    return members, labels


def join(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id among the documents that links reach, itself included."""
    members, labels = classes(common.texts(docs), limits)
    nodes = common.stored(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left"), "nodes")
    least = common.stored(nodes.where("component is not null").groupBy("component").agg(F.min("least").alias("of_all")), "least")
    named = common.stored(nodes.join(least, "component", "left").select("node", F.coalesce("of_all", "least").alias("of_node")), "named")
    out = members.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("of_node", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive d as (select doc_id, row_number() over () as n, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, n, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from d),
e as (select n, len(s) as size, unnest(s) as g from s),
p as (select x.n as a, y.n as b from e x join e y on x.g = y.g and x.n < y.n and 4 * least(x.size, y.size) >= 3 * greatest(x.size, y.size)
  group by x.n, y.n, x.size, y.size having 100 * count(*) >= 75 * (x.size + y.size - count(*))),
u as (select a, b from p union all select b, a from p),
r as (select n as a, n as b from s union select r.a, u.b from r join u on r.b = u.a)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id from s join (select a as n, min(s2.doc_id) as component_id from r join s s2 on r.b = s2.n group by a) using (n)
"""

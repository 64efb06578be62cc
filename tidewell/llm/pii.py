"""Information-theoretic sanitisation of personal data.

Four kinds of protected entities are found by their form (the base spans). Corpus co-occurrence then tells which other
terms reveal them. A term t reveals an entity e by their pointwise mutual information, as a share of the entity's own
information: disclosure = PMI(t; e) / -log2 p(e), with p over different texts. At 1 every text with t holds e beside it.
A term whose disclosure exceeds the threshold for some entity is sanitised wherever it stands: generalised to a
placeholder, or removed where it is as good as the entity itself. Terms are words with a letter; they co-occur with an
entity within a window of words around it. All counts are of different texts, told apart by 64-bit hashes, so copies of
a document are no evidence, and a term needs more than one text.

Counts cover all documents. The first pass finds entities and the terms beside them; the second counts in how many
texts those candidate terms stand at all; the third marks the terms that disclose. Which words the second and
third pass look at is told by Bloom filters of a fixed size, and exact joins follow, so nothing that grows with the
corpus is sent to executors or to the driver.

Null texts count as empty; every row gets a row. Rows with a null id are scanned for base kinds and have the terms of
the other rows. Spans are code points, end exclusive; added spans have kind `term` and never overlap a base span.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

# The kinds in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits is matched whole or not at all, so a match can only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @ with the longest local part before it that no earlier match has taken."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        free = max(free, start)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass(frozen=True)
class Limits:
    """window: words each side of an entity. support: different texts in which a term must stand beside an entity.
    generalise, remove: the disclosure from which a term is generalised, and removed."""

    window: int = 5
    support: int = 2
    generalise: float = 0.95
    remove: float = 0.99
    filter_bits: int = 1 << 23


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _nearest(text: str, at: int, n: int, back: bool) -> list[str]:
    """The n words before or behind a place, however long they and what parts them are."""
    reach = 40 * n
    while True:
        a, b = (max(0, at - reach), at) if back else (at, min(len(text), at + reach))
        found = _words(text[a:b])
        if len(found) > n or (a == 0 if back else b == len(text)):  # with one more, none of the n is cut off
            return found[-n:] if back else found[:n]
        reach *= 4


def _slots(words: list[str], bits: int) -> list[int]:
    """Two places of each word in a filter."""
    out = []
    for w in words:
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out += [int.from_bytes(h[:4], "little") % bits, int.from_bytes(h[4:], "little") % bits]
    return out


def _filter(terms: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column `term`, made by the executors: one of `bits` bits a task, united two by two."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, dtype=bool)
        for batch in batches:
            held[_slots(batch.column(0).to_pylist(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(held).tobytes(), 1)], pa.binary())], ["bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for x in batch.column(0):
                held |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["bits"])

    made = terms.select("term").mapInArrow(fill, "bits binary").coalesce(8).mapInArrow(unite, "bits binary").collect()  # at most 8 filters
    held = np.zeros(bits // 8, dtype=np.uint8)
    for r in made:
        held |= np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
    return np.unpackbits(held).astype(bool)


class _Seen:
    """Whether a filter holds a word, remembered by word while there is room."""

    def __init__(self, held: np.ndarray):
        self.held, self.known = held, {}

    def __call__(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            a, b = _slots([word], len(self.held))
            known = bool(self.held[a] and self.held[b])
            if len(self.known) < 500_000:
                self.known[word] = known
        return known


def beside(docs: DataFrame, limits: Limits) -> DataFrame:
    """entity, term, context: a row for each entity (term null) and for each word in its window. context is the hash of
    the text, which comes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, str | None, int]] = set()
            for text, context in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                for start, kind, end in base_spans(text):
                    entity = f"{KINDS[kind]}:{text[start:end].lower()}"
                    before, after = _nearest(text, start, limits.window, True), _nearest(text, end, limits.window, False)
                    rows.add((entity, None, context))
                    rows |= {(entity, w, context) for w in {*before, *after}}
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["entity", "term", "context"])

    return docs.select("text", F.xxhash64("text")).mapInArrow(run, "entity string, term string, context long")


def standing(docs: DataFrame, held: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """term, n_term: in how many different texts each word that the filter `held` holds stands. Texts whose hash the
    filter `repeated` lacks stand once and are counted where they are read; the others are told apart by their hash."""
    schema = pa.schema([("context", pa.int64()), ("terms", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, copied, met = _Seen(held), _Seen(repeated), set()
        for batch in batches:
            counts: Counter[str] = Counter()
            rows: list[tuple[int | None, list[str], list[int]]] = []
            for text, context in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if context in met:
                    continue
                terms = [w for w in set(_words(text.as_py())) if seen(w)]
                if not copied(str(context)):
                    counts.update(terms)
                    continue
                rows.append((context, terms, []))
                if len(met) < 500_000:
                    met.add(context)
            rows.append((None, list(counts), list(counts.values())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = common.stored(docs.select("text", F.xxhash64("text")).mapInArrow(run, "context long, terms array<string>, n array<long>"), "standing")
    once = found.where("context is null").select(F.explode(F.arrays_zip("terms", "n")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.n").alias("n"))
    copies = found.where("context is not null").select("context", "terms").dropDuplicates(["context"]).select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n"))
    return once.unionByName(copies).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """term, disclosure, entity_kind: the terms that reveal some entity, with the most they reveal."""
    pairs = common.stored(beside(docs, limits), "beside")
    entities = pairs.where(F.col("term").isNull()).groupBy("entity").agg(F.count_distinct("context").alias("n_entity"))
    shared = pairs.where(F.col("term").isNotNull()).groupBy("entity", "term").agg(F.count_distinct("context").alias("n_both")).where(F.col("n_both") >= limits.support)
    shared = common.stored(shared, "shared")
    texts = common.stored(docs.groupBy(F.xxhash64("text").alias("context")).count(), "texts")
    total = texts.count()
    repeated = _filter(texts.where(F.col("count") > 1).select(F.col("context").cast("string").alias("term")), limits.filter_bits)
    stands = standing(docs, _filter(shared.select("term").distinct(), limits.filter_bits), repeated)
    # Beside an entity a word may be cut off that stands whole in fewer texts, so the joint count is cut to that.
    pmi = F.log2(F.least("n_both", "n_term") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    disclosure = F.when(F.col("n_entity") < total, pmi / F.log2(F.lit(float(total)) / F.col("n_entity"))).otherwise(F.lit(0.0))
    scored = shared.join(entities, "entity").join(stands, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= limits.generalise)
    best = F.max_by(F.struct(F.substring_index("entity", ":", 1).alias("kind"), "disclosure"), F.struct("disclosure", "entity"))
    return scored.groupBy("term").agg(best.alias("x")).select("term", "x.disclosure", F.col("x.kind").alias("entity_kind"))


SPANS = "array<struct<start:int,nth:int,end:int,kind:string,action:string>>"


def annotate(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, crc (of the text) and spans (array of start, nth, end, kind, action) for every row: base spans have action
    `generalise`; spans of kind `term` are those of disclosing terms."""
    whole = common.texts(docs)
    terms = common.stored(disclosing(whole, limits), "disclosing")
    held = _filter(terms, limits.filter_bits)
    any_term = bool(held.any())
    span = pa.list_(pa.struct([("start", pa.int32()), ("nth", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("action", pa.string())]))
    words = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(held)
        for batch in batches:
            spans, maybe, crcs = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                spans.append([{"start": a, "nth": k, "end": b, "kind": KINDS[k], "action": "generalise"} for a, k, b in base])
                crcs.append(zlib.crc32(text.encode()))
                places: dict[str, list[int]] = defaultdict(list)
                if any_term:
                    for m in _WORD.finditer(text):
                        if seen(w := m[0].lower()) and not any(a < m.end() and m.start() < b for a, _, b in base):
                            places[w] += [m.start(), m.end()]
                maybe.append([{"term": w, "at": at} for w, at in places.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(spans, span), pa.array(maybe, words)], ["doc_id", "crc", "spans", "maybe"])

    found = whole.mapInArrow(run, f"doc_id long, crc long, spans {SPANS}, maybe array<struct<term:string,at:array<int>>>")
    if not any_term:
        return found.drop("maybe")
    # The exact join takes the words that the filter holds and their places, never texts.
    found = common.stored(found, "annotated")
    keyed = found.select("doc_id", "crc", F.explode("maybe").alias("x")).select("doc_id", "crc", "x.term", "x.at").distinct()
    hit = keyed.join(terms, "term").withColumn("action", F.when(F.col("disclosure") >= limits.remove, "remove").otherwise("generalise"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.get("at", i).alias("start"), F.lit(len(KINDS)).alias("nth"), F.get("at", i + 1).alias("end"), F.lit("term").alias("kind"), F.col("action").alias("action")))
    more = hit.select("doc_id", "crc", pairs.alias("p")).groupBy("doc_id", "crc").agg(F.flatten(F.collect_list("p")).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "id", "crc": "c"})
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("crc") == F.col("c")), "left")
    return joined.select("doc_id", "crc", F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def sanitise(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, sanitised: base spans become [EMAIL] and the like, terms [TERM], or nothing where they are removed."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        mark = F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["parts"], F.array(gap, mark))).otherwise(state["parts"]).alias("parts"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    marked = annotate(docs, limits).distinct().withColumnsRenamed({"doc_id": "id", "crc": "c"})
    whole = common.texts(docs).withColumn("crc", F.crc32("text"))
    return whole.join(marked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("crc") == F.col("c"))).select("doc_id", clean.alias("sanitised"))


def op1_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(common.table(spark, sf_dir, "documents"))
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["nth"] < len(KINDS))
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind

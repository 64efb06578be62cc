"""Language identification with error-correcting output codes.

Every language has a codeword. A binary classifier for each bit sees hashed byte n-grams (two and three bytes of the
lowered text, anything but letters as white space) and tells the languages with a 1 from those with a 0 by the mean
log odds of its n-grams, set so that a typical text of either side gets +1 or -1. Loss-weighted decoding adds up each
bit's logistic loss, weighted by how well the bit tells its sides apart, and takes the codeword of least loss; a
runner-up that is too near flags the text as ambiguous.

The n-gram counts of each language come from all training texts: one vector a language and task, added up by slices. The
driver holds the names, totals and codewords of the languages and the classifiers, whose number grows with the logarithm of that of
the languages; the counts stay in the shared folder.

A text that is null or has no letter gets `und` and score 0; so does every text if nothing was learned. With a single
learned language every text with a letter gets it. Each row gets a row; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

#: Hashed n-grams of either length.
PLACES = 1 << 14
SLICES = 16
#: Languages up to which the best of many random codes is looked for, and (text, language, bit) triples decoded at a time.
COMPARED, AT_ONCE = 1024, 1 << 24
UNKNOWN = "und"
_CHUNK = 1 << 18
_CLEAN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], dtype=np.uint8)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned bytes of all texts, each with two blanks before and one behind, and where each begins (and the last ends)."""
    raw = [b"  " + t.lower().encode() + b" " for t in texts]
    return _CLEAN[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.cumsum([0, *map(len, raw)])


def grams(held: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs and triples that begin at a..b-1. The blanks around a text keep its own from its neighbours."""
    part = np.append(held[a : b + 2], np.zeros(max(0, b + 2 - len(held)), np.uint8) + 32).astype(np.uint32)
    x, y, z = part[:-2], part[1:-1], part[2:]
    two = (x * np.uint32(40503) + y * np.uint32(30011)) >> np.uint32(3)
    three = (x * np.uint32(2654435761) ^ y * np.uint32(2246822519) ^ z * np.uint32(3266489917)) >> np.uint32(13)
    mask = np.uint32(PLACES - 1)
    return (two & mask).astype(np.intp), (three & mask).astype(np.intp) + PLACES


@dataclass(frozen=True)
class Model:
    """weights: n-gram by bit; centre, half: middle and half distance of the two sides of a bit; near: the least loss
    (a share of the winner's lead over all bits) by which the runner-up has to lose."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    half: np.ndarray
    trust: np.ndarray
    sharpness: float = 3.0
    near: float = 0.6


def codewords(n: int) -> np.ndarray:
    """+1 and -1, a row a language: all ways to part up to 6 languages in two; for more, the best spread of random codes."""
    if n <= 6:
        return np.array([[1 if k == 0 or not (bits >> (k - 1)) & 1 else -1 for bits in range(1, 1 << (n - 1))] for k in range(n)], dtype=np.int8).reshape(n, -1)
    rng, size = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200 if n <= COMPARED else 1):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (n, size))
        if n > COMPARED:
            return code
        apart = (size - code.astype(int) @ code.T.astype(int)) // 2 + size * np.eye(n, dtype=int)
        if apart.min() > most and np.all(np.abs(code.sum(axis=0)) < n):
            best, most = code, apart.min()
    return best


SUMS = "lang string, slice int, total double, sums binary"
_WIDTH = 2 * PLACES // SLICES


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["lang", "slice", "total", "sums"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, slice, total, sums: n-gram counts (doubles) by language over all rows of (lang, text), by slice of the places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        out = lambda: _batch([(lang, k, 0.0, v[k * _WIDTH : (k + 1) * _WIDTH].tobytes()) for lang, v in sums.items() for k in range(SLICES)])
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                held, _ = joined(texts)
                own = sums.setdefault(lang, np.zeros(2 * PLACES))
                for a in range(0, len(held), _CHUNK):
                    for places in grams(held, a, min(len(held), a + _CHUNK)):
                        own += np.bincount(places, minlength=2 * PLACES)
                if len(sums) >= 256:
                    yield out()
                    sums = {}
        yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for lang, k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (lang, k) != now:
                    if now:
                        yield _batch([(*now, float(sums.sum()), sums.tobytes())])
                    now, sums = (lang, k), np.zeros(_WIDTH)
                sums += np.frombuffer(v.as_py())
        if now:
            yield _batch([(*now, float(sums.sum()), sums.tobytes())])

    return common.bounded(docs).select("lang", "text").mapInArrow(run, SUMS).repartition("lang", "slice").sortWithinPartitions("lang", "slice").mapInArrow(add, SUMS)


def learn(docs: DataFrame) -> Model:
    """From the rows of docs with a language and a text."""
    found = common.stored(counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")), "grams")
    total = {r["lang"]: r["total"] for r in found.groupBy("lang").agg(F.sum("total").alias("total")).where("total > 0").collect()}
    names = tuple(sorted(total))
    codes = codewords(len(names)) if names else np.zeros((0, 0), np.int8)
    if len(names) < 2:
        none = np.zeros(0)
        return Model(names, codes, np.zeros((2 * PLACES, 0), np.float32), none, none, none)
    place, bits = {lang: k for k, lang in enumerate(names)}, codes.shape[1]
    share = lambda lang, v: (np.frombuffer(v) + 0.1) / (total[lang] + 0.2 * PLACES)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if lang in place:
                    one = codes[place[lang]] > 0
                    held.setdefault(k, np.zeros((2, bits, _WIDTH)))[np.where(one, 0, 1), np.arange(bits)] += share(lang, v.as_py())
        for k, x in held.items():
            yield _batch([(None, k, 0.0, x.astype(np.float32).tobytes())])

    both = np.zeros((2, bits, 2 * PLACES), np.float32)
    for r in found.repartition(SLICES, "slice").sortWithinPartitions("slice", "lang").mapInArrow(sides, SUMS).toLocalIterator():
        both[:, :, r["slice"] * _WIDTH : (r["slice"] + 1) * _WIDTH] = np.frombuffer(bytes(r["sums"]), np.float32).reshape(2, bits, _WIDTH)
    ones = (codes > 0).sum(axis=0)
    weights = np.log((both[0] / ones[:, None]) / (both[1] / (len(names) - ones)[:, None]))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bit, the least mean of a language with a 1 and the greatest of one with a 0."""
        high, low, now, own = np.full(bits, np.inf), np.full(bits, -np.inf), None, np.zeros(bits)

        def close() -> None:
            if now in place:
                one = codes[place[now]] > 0
                high[one], low[~one] = np.minimum(high, own)[one], np.maximum(low, own)[~one]

        for batch in batches:
            for lang, k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if lang not in place:
                    continue
                if lang != now:
                    close()
                    now, own = lang, np.zeros(bits)
                own += sent.value[:, k * _WIDTH : (k + 1) * _WIDTH] @ share(lang, v.as_py())
        close()
        yield _batch([(None, 0, 0.0, np.stack([high, low]).tobytes())])

    ends = [np.frombuffer(bytes(r["sums"])).reshape(2, bits) for r in found.repartition("lang").sortWithinPartitions("lang", "slice").mapInArrow(typical, SUMS).toLocalIterator()]
    high, low = np.min([x[0] for x in ends], axis=0), np.max([x[1] for x in ends], axis=0)
    sent.destroy()
    half = np.maximum((high - low) / 2, 1e-3)
    return Model(names, codes, weights.T.astype(np.float32), (high + low) / 2, half, half / half.sum())


def decode(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, for each text."""
    lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    if len(model.languages) == 1:
        return [model.languages[0] if x else UNKNOWN for x in lettered], lettered.astype(float), np.zeros(len(texts), dtype=bool)
    held, begins = joined(texts)
    sums = np.zeros((len(texts), model.weights.shape[1]))
    for a in range(0, len(held), _CHUNK):
        b = min(len(held), a + _CHUNK)
        first, last = np.searchsorted(begins, a, side="right") - 1, np.searchsorted(begins, b, side="left")
        cuts = np.maximum(begins[first:last], a) - a
        for places in grams(held, a, b):
            sums[first:last] += np.add.reduceat(model.weights[places], cuts, axis=0)
    means = sums / (2 * np.diff(begins))[:, None]
    sides = np.clip((means - model.centre) / model.half, -3, 3) * model.sharpness
    loss = np.empty((len(texts), len(model.languages)))
    step = max(1, AT_ONCE // model.codes.size)
    for a in range(0, len(texts), step):
        margins = sides[a : a + step, None, :] * model.codes[None]
        loss[a : a + step] = (np.logaddexp(0, -margins) * model.trust * len(model.trust)).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    best, second = loss[np.arange(len(texts)), order[:, 0]], loss[np.arange(len(texts)), order[:, 1]]
    odds = np.exp(best[:, None] - loss)
    score = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
    return [model.languages[k] if x else UNKNOWN for k, x in zip(order[:, 0], lettered, strict=True)], score, lettered & (second - best < model.near)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, and the columns named in keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    asked = common.bounded(docs).select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, ambiguous = decode(sent.value, [x or "" for x in batch.column(0).to_pylist()])
            columns = [batch.column(k) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], [*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[1:])
    return asked.mapInArrow(run, schema + ", lang_pred string, score double, ambiguous boolean")


def rejected(text: str | None, lang: str, ambiguous: bool) -> bool:
    """No letter at all; or ambiguous and for the most part not letters."""
    return lang == UNKNOWN or (ambiguous and 2 * sum(map(str.isalpha, text or "")) < len(text or ""))


def spoken(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in some language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            lang, _, ambiguous = decode(sent.value, texts)
            yield batch.filter(pa.array([not rejected(*x) for x in zip(texts, lang, ambiguous.tolist(), strict=True)], pa.bool_()))

    return common.bounded(docs).mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")

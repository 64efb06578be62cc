"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (windows of its bytes). Each passage is encoded: its character make-up and hashed byte
pairs pass through a learned layer to h. Gated attention a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the
passages, and the document's score is sigmoid(c . sum(a h) + d). Encoder, attention and score are learned together from
document labels alone, on the driver, from at most `sample` labelled documents taken by a hash of their id, and of those
at most `bag` passages each, evenly over the text; every document is then scored over its whole text.

Null and empty texts are a bag of one empty passage and get a score as any other. Several labels of a document count by
their mean; null labels do not count. Without labels of both kinds every score is the share of good labels (0.5 without
any). Each row gets a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

PASSAGE = 1024
PAIRS = 128
_CLASSES = [str.islower, str.isupper, str.isdigit, lambda c: c == " ", lambda c: c == "\n", lambda c: c in ".,;:", lambda c: c in "!?", lambda c: c == "|", lambda c: c in "#$%&*", lambda c: c in "()[]{}<>", lambda c: c in "'\"-_/\\"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _c in range(128):
    for _k, _f in enumerate(_CLASSES):
        if _f(chr(_c)):
            _CLASS[_c] = _k
            break
_WIDTH = len(_CLASSES) + 1
FEATURES = _WIDTH + 4 + PAIRS


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and where each text's passages begin (and the last end)."""
    raw = [t.encode() or b"\0" for t in texts]
    sizes = np.array([len(r) for r in raw])
    bags = -(-sizes // PASSAGE)
    begins = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((begins[-1], FEATURES), dtype=np.float32)
    held = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    nth = np.arange(begins[-1]) - np.repeat(begins[:-1], bags)
    at = np.append(np.repeat(starts[:-1], bags) + nth * PASSAGE, len(held))
    step = 2048  # passages at a time
    for a in range(0, len(at) - 1, step):
        b = min(len(at) - 1, a + step)
        part = held[at[a] : at[b]]
        of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        n = np.diff(at[a : b + 1]).astype(np.float64)[:, None]
        kind = _CLASS[part]
        made = np.bincount(of * _WIDTH + kind, minlength=(b - a) * _WIDTH).reshape(b - a, _WIDTH)
        pair = (part[:-1].astype(np.int64) * 31 + part[1:].astype(np.int64) * 17) % PAIRS
        inside = of[1:] == of[:-1]  # pairs of one passage; none reaches into the next
        pairs = np.bincount((of[:-1] * PAIRS + pair)[inside], minlength=(b - a) * PAIRS).reshape(b - a, PAIRS)
        spaces = made[:, 3:5].sum(axis=1, keepdims=True)
        doubled = np.bincount(of[1:], weights=(part[1:] == part[:-1]) & inside, minlength=b - a)[:, None]
        changes = np.bincount(of[1:], weights=(kind[1:] != kind[:-1]) & inside, minlength=b - a)[:, None]
        out[a:b] = np.hstack([np.sqrt(made / n), n / PASSAGE, spaces / n * 4, doubled / n * 4, changes / n, np.sqrt(pairs / n)])
    return out, begins


@dataclass(frozen=True)
class Limits:
    """sample: labelled documents to learn from, at most; the others are not needed to fit so few weights. bag: passages
    of each, at most. The driver so holds 2 * FEATURES * sample * bag bytes, 46 MB, at most."""

    sample: int = 5000
    bag: int = 32
    hidden: int = 24
    gates: int = 12
    rounds: int = 40
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4


class Model:
    def __init__(self, limits: Limits, share: float):
        rng = np.random.default_rng(11)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h, g = limits.hidden, limits.gates
        self.share, self.fitted = share, False
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"E": init(FEATURES, h), "e": np.zeros(h, np.float32), "V": init(h, g), "U": init(h, g), "w": init(g), "c": init(h), "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, first = self.p, begins[:-1]
        of = np.repeat(np.arange(len(first)), np.diff(begins))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[of])
        a = a / np.add.reduceat(a, first)[of]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return y, {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "of": of}

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.share)
        return self.forward(*passages(texts))[0].astype(np.float64)

    def attention(self, text: str) -> np.ndarray:
        """The weight of each passage of a text."""
        return self.forward(*passages([text]))[1]["a"]

    def gradients(self, x: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        y, k = self.forward(x, begins)
        p, of, n = self.p, k["of"], len(labels)
        dy = ((y - labels) / n).astype(np.float32)
        dz = dy[:, None] * p["c"]
        da = (dz[of] * k["h"]).sum(axis=1)
        du = k["a"] * (da - np.add.reduceat(k["a"] * da, begins[:-1])[of])
        dg = du[:, None] * p["w"]
        dt, ds = dg * k["s"] * (1 - k["t"] ** 2), dg * k["t"] * k["s"] * (1 - k["s"])
        dh = k["a"][:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - k["h"] ** 2)
        return {"E": k["x"].T @ dx, "e": dx.sum(axis=0), "V": k["h"].T @ dt, "U": k["h"].T @ ds, "w": (k["t"] * k["s"]).T @ du, "c": k["z"].T @ dy, "d": dy.sum(keepdims=True)}


def fit(x: np.ndarray, begins: np.ndarray, labels: np.ndarray, limits: Limits = Limits()) -> Model:
    model = Model(limits, float(labels.mean()) if len(labels) else 0.5)
    if len(labels) < 2 or labels.min() == labels.max():
        return model
    model.fitted = True
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.02
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    rng, step, n = np.random.default_rng(3), 0, len(labels)
    for turn in range(limits.rounds):
        rate = limits.rate * 0.5 * (1 + np.cos(np.pi * turn / limits.rounds))
        order = rng.permutation(n)
        for a in range(0, n, limits.batch):
            own = np.sort(order[a : a + limits.batch])
            rows = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in own])
            cuts = np.concatenate([[0], np.cumsum(begins[own + 1] - begins[own])])
            step += 1
            for k, g in model.gradients(x[rows], cuts, labels[own]).items():
                g = g + limits.decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """labels: doc_id and quality, of which no row is held out."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("quality"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(limits.sample))  # at most `sample` rows of 16 bytes
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x, begins = passages(texts)
            rows = [x[np.linspace(a, b - 1, min(b - a, limits.bag)).astype(int)].astype(np.float16).tobytes() for a, b in zip(begins, begins[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "quality", "features"])

    rows = found.select("id", "text", "quality").mapInArrow(run, "id long, quality double, features binary")
    # Of the rows of an id that repeats, one.
    rows = rows.groupBy("id").agg(F.min(F.struct(F.crc32("features"), "features", "quality")).alias("x")).select("id", "x.quality", "x.features").collect()
    rows.sort(key=lambda r: r["id"])
    bags = [np.frombuffer(bytes(r["features"]), dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32), begins, np.array([r["quality"] for r in rows]), limits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score(batch.column(1).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(found, 0, 1), pa.float64())], ["doc_id", "score"])

    return common.texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = learn(docs, common.table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

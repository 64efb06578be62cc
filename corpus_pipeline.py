"""The corpus pipeline: documents in some language, one of each group of near copies, none with benchmark items, secrets
redacted, packed into training sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, jaccard, language, packing, secrets

#: Keys of 16 bytes up to which a filter sends them to every executor; more of them are joined by a shuffle.
SMALL = 1_000_000


def _keys() -> list[Column]:
    """Filters decide by text, told by 128 bits; ids may be null or repeated."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit("second"), text).alias("key2")]


def _held(docs: DataFrame, rows: DataFrame, count: int, how: str) -> DataFrame:
    """docs joined by id and text with rows (doc_id, key, key2)."""
    rows = F.broadcast(rows) if count <= SMALL else rows
    key, key2 = _keys()
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["doc_id"]) & (key == rows["key"]) & (key2 == rows["key2"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are ambiguous while most of their characters are no letters."""
    return language.spoken(docs, language.learn(docs.where(~language.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the smallest id; rows without an id come last. Texts
    without a word are in no group and stay."""
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *_keys()).alias("doc_id")
    members, labels = jaccard.classes(common.bounded(docs).select(ids, F.coalesce("text", F.lit("")).alias("text")))
    fields = [F.col("x.id").alias("doc_id"), "x.key", "x.key2"]
    grouped = members.where("n > 0").join(labels, "node", "left").select(F.coalesce("component", "node").alias("group"), F.col("doc_id").alias("x"))
    grouped = common.stored(grouped.groupBy("group", "x").agg(F.count("*").alias("n")), "rows")
    least = common.stored(grouped.groupBy("group").agg(F.min(F.struct("x", "n")).alias("least")).select("least.x", "least.n"), "least")
    gone, n = common.stored_rows(grouped.join(least.select("x"), "x", "left_anti").select(*fields), "gone")
    out = _held(docs, gone, n, "left_anti")
    # Rows of the same id and text: one of them.
    repeated, n = common.stored_rows(least.where("n > 1").select(*fields), "repeated")
    if not n:
        return out
    twice = _held(out, repeated, n, "left_semi").select("doc_id", *_keys(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return _held(out, repeated, n, "left_anti").unionByName(twice.dropDuplicates(["doc_id", "key", "key2"]).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text leaks a benchmark item go, whatever their id."""
    whole = common.bounded(docs).select(F.struct("doc_id", *_keys()).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = decontaminate.leaks(whole, common.table(spark, sf_dir, "benchmark"))
    go, n = common.stored_rows(found.select("doc_id.*").distinct(), "go")
    return _held(docs, go, n, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it become placeholders."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Language identification and packing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

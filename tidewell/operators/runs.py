"""Counters and records of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def section_counts(df: DataFrame, section: str) -> DataFrame:  # A3
    """A map of counts, with keys in order."""
    by = df.groupBy(section).agg(F.count("*").cast("int").alias("n"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(section, "n")))).alias("section_counts"))


def last_sent(runs: DataFrame, columns: list[str]) -> DataFrame:  # A7, A8
    return runs.where("status = 'SENT'").agg(F.max(F.coalesce(*columns)).alias("last_sent_at"))


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:  # A9, A22, J13
    return df.join(keys, key, "left_semi")


def one_fingerprint(runs: DataFrame, key: str, payload: str) -> DataFrame:  # A11
    """Keys with one payload; an error if a key has two."""
    by = runs.groupBy(key).agg(F.count_distinct(F.sha2(payload, 256)).alias("n"), F.max(payload).alias(payload))
    return by.withColumn(payload, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting payloads for "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(payload))).drop("n")


def repeated(df: DataFrame, key: Column) -> DataFrame:  # A17
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def item_counts(results: DataFrame, later: DataFrame, key: str) -> DataFrame:  # A13
    """Items per job; counts of the later table win where a job has both."""
    a, b = (x.groupBy(key).agg(F.count("*").alias("items")) for x in (results, later))
    return b.unionByName(a.join(b, key, "left_anti"))


def or_default(df: DataFrame, default: DataFrame) -> DataFrame:  # F29
    """The rows of df, or the default ones if it has none."""
    some = df.limit(1).select(F.lit(1).alias("_s"))
    return df.unionByName(default.withColumn("_k", F.lit(1)).join(some, F.col("_k") == F.col("_s"), "left_anti").drop("_k"))


def run_record(status: Column, completed_at: Column) -> Column:  # F32
    """An edition that waits to be sent has no time of completion."""
    return F.when(status == "READY_TO_SEND", F.lit(None).cast("timestamp")).otherwise(completed_at)


def commit_guard(message_id: Column, thread_id: Column) -> Column:  # F33
    return tx.blank_to_null(message_id).isNotNull() & tx.blank_to_null(thread_id).isNotNull()


def latest_state(runs: DataFrame, ts: str, n: int) -> DataFrame:  # A18
    return runs.orderBy(F.desc(ts)).limit(n)

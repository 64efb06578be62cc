"""Collection jobs: template expansion, cadence, manual choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def expand(sources: DataFrame, dimensions: dict[str, tuple[tuple[str, ...], DataFrame]]) -> DataFrame:  # F1, J5
    """One job per source and combination of the dimensions that its URL names. dimensions: name to (patterns, values),
    values with a column `value`. A dimension without values gives one job with an error instead of none."""
    jobs = sources.where("active").withColumns({"resolved_url": F.col("url"), "source_job_key": F.col("source_id"), "configuration_errors": F.array().cast("array<string>")})
    for name, (patterns, values) in dimensions.items():
        own = values.select(F.col("value").alias("_value"), F.lit(True).alias("_on"))
        jobs = jobs.withColumn("_asked", tx.has_template(F.col("url"), patterns))
        # The flag makes this an equi-join; only sources with the placeholder meet the values.
        jobs = jobs.join(own, (F.col("_asked") == F.col("_on")) & F.col("_asked"), "left")
        jobs = jobs.withColumns(
            {
                "resolved_url": F.when(F.col("_value").isNotNull(), tx.filled_template(F.col("resolved_url"), patterns, F.col("_value"))).otherwise(F.col("resolved_url")),
                "source_job_key": F.when(F.col("_value").isNotNull(), F.concat_ws(":", "source_job_key", "_value")).otherwise(F.col("source_job_key")),
                "configuration_errors": F.when(F.col("_asked") & F.col("_value").isNull(), F.array_append("configuration_errors", F.lit(f"MISSING_{name.upper()}"))).otherwise(F.col("configuration_errors")),
            }
        ).drop("_asked", "_value", "_on")
    return jobs


def due(as_of: Column, last_attempt: Column, quarantined_until: Column, minutes: Column) -> Column:  # F2
    """Never tried: due. In quarantine: not due. Otherwise by elapsed minutes."""
    elapsed = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_attempt.cast("timestamp"))) / 60e6
    return F.when(last_attempt.isNull(), True).when(quarantined_until.isNotNull() & (quarantined_until > as_of), False).otherwise(elapsed >= minutes)


def not_quarantined(as_of: Column, quarantined_until: Column) -> Column:  # F3
    return quarantined_until.isNull() | (quarantined_until <= as_of)


def with_latest(jobs: DataFrame, latest: DataFrame) -> DataFrame:  # J1
    return jobs.join(latest, "source_job_key", "left")


def chosen(jobs: DataFrame, source_id: str, seq: str) -> DataFrame:  # F4
    return jobs.where(F.col("source_id") == source_id).orderBy(seq).limit(1)


def missing_ids(requested: DataFrame, registry: DataFrame, key: str) -> DataFrame:  # J14, U3
    return requested.join(registry, key, "left_anti")


def in_order(results: DataFrame, jobs: DataFrame, key: str, seq: str, within: str) -> DataFrame:  # T6
    """Results in the order of their jobs, whatever order they were made in; those of a job by `within`."""
    return results.join(jobs.select(key, F.col(seq).alias("_seq")), key).orderBy("_seq", within).drop("_seq")

"""Health of collection jobs: receipts, failure streaks and quarantine, the gate before an edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx

HEALTHY = ("SUCCESS", "UNCHANGED", "VALID_EMPTY")
LANES = ("venture_debt", "competitor_deposit", "ai")


def streaks(receipts: DataFrame, key: str, seq: list[str], ok: Column, ts: str, threshold: int = 3, hours: int = 24) -> DataFrame:  # W9, W10, ST7 in batch
    """Adds consecutive_failures, status (QUARANTINED from the threshold on), quarantined_until and last_success_at."""
    w = Window.partitionBy(key).orderBy(*seq)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = receipts.withColumn("_ok", ok).withColumn("_island", F.sum(F.col("_ok").cast("int")).over(before))
    in_island = Window.partitionBy(key, "_island").orderBy(*seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = island.withColumn("consecutive_failures", F.sum((~F.col("_ok")).cast("int")).over(in_island).cast("int"))
    quarantined = F.col("consecutive_failures") >= threshold
    return out.withColumns(
        {
            "status": F.when(quarantined, "QUARANTINED").when(F.col("_ok"), "SUCCESS").otherwise("FAILED"),
            "quarantined_until": F.when(quarantined, F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")),
            "last_success_at": F.last(F.when(F.col("_ok"), F.col(ts)), ignorenulls=True).over(before),
        }
    ).drop("_ok", "_island")


def job_health(jobs: DataFrame, latest: DataFrame, as_of: Column, hours: int = 36) -> DataFrame:
    """Adds `ok`: the latest receipt exists, is healthy, of the job's parser version and not older than `hours`."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    ok = F.col("health_status").isin(*HEALTHY) & F.col("parser_version").eqNullSafe(F.col("receipt_version")) & (age >= 0) & (age <= F.lit(hours * 3600 * 10**6))
    return jobs.join(latest, "source_job_key", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))


def gate(checked: DataFrame, least_ratio: float, collector_fresh: Column) -> DataFrame:  # A4, A5, A6
    """One row from jobs with ok, due and lane: the ratio over due jobs (over all if none is due), lanes covered by any
    healthy job out of the fixed three, and the reasons that stand against it in order."""
    totals = checked.agg(
        F.count_if("due").alias("n_due"),
        F.count("*").alias("n_all"),
        F.count_if(F.col("due") & F.col("ok")).alias("ok_due"),
        F.count_if("ok").alias("ok_all"),
        *(F.coalesce(F.bool_or(F.col("ok") & (F.col("lane") == x)), F.lit(False)).alias(f"has_{x}") for x in LANES),
    )
    scoped = totals.select(
        F.when(F.col("n_due") > 0, F.col("n_due")).otherwise(F.col("n_all")).alias("expected_jobs"),
        F.when(F.col("n_due") > 0, F.col("ok_due")).otherwise(F.col("ok_all")).alias("healthy_jobs"),
        F.array_compact(F.array(*(F.when(F.col(f"has_{x}"), F.lit(x)) for x in LANES))).alias("covered_lanes"),
        F.array_compact(F.array(*(F.when(~F.col(f"has_{x}"), F.lit(x)) for x in LANES))).alias("missing_lanes"),
    )
    ratio = F.when(F.col("expected_jobs") > 0, F.col("healthy_jobs") / F.col("expected_jobs")).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("expected_jobs") == 0, "NO_CORE_SOURCE_JOBS"),
            F.when((F.col("expected_jobs") > 0) & (F.col("healthy_ratio") < least_ratio), "CORE_COVERAGE_BELOW_THRESHOLD"),
            F.when(F.size("missing_lanes") > 0, "CORE_LANE_SOURCE_MISSING"),
            F.when(~collector_fresh, "COLLECTOR_STALE_OR_MISSING"),
        )
    )
    return scoped.withColumn("healthy_ratio", ratio).withColumn("reason_codes", reasons).withColumn("healthy", F.size("reason_codes") == 0)


def receipts(outcomes: DataFrame, policy_version: str) -> DataFrame:  # F25
    """Receipts of candidate outcomes (decision or error): failures count up, dispositions are valid and say why in notes."""
    failed = F.col("error_type").isNotNull()
    reason = F.when(failed, F.array(tx.reason_code(F.col("error_type")))).when(F.col("decision") == "DROP", F.array(F.lit("EVIDENCE_DROP"))).when(F.col("decision") == "NEEDS_PRIMARY_SOURCE", F.array(F.lit("NEEDS_PRIMARY_SOURCE"))).otherwise(F.array().cast("array<string>"))
    notes = F.to_json(F.struct(F.col("content_hash"), F.lit(policy_version).alias("evidence_policy_version")))
    return outcomes.select(
        "source_job_key",
        "candidate_id",
        F.when(failed, "FAILED").when(F.col("decision") == "KEEP", "SUCCESS").otherwise("VALID_EMPTY").alias("health_status"),
        F.when(failed, F.col("previous_failures") + 1).otherwise(0).alias("consecutive_failures"),
        F.lit("evidence_guard").alias("failure_stage"),
        reason.alias("reason_codes"),
        F.when(~failed & (F.col("decision") != "KEEP"), notes).alias("notes"),
    )

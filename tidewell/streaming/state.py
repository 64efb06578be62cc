"""Structured Streaming variants: deduplication of revisions, job state machines, idempotent sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "failures int, last_success timestamp"
RECEIPT = "source_job_key string, ts timestamp, consecutive_failures int, status string, quarantined_until timestamp, last_success_at timestamp"


def deduplicated(stream: DataFrame, key: str, ts: str, horizon: str = "8 days") -> DataFrame:  # ST3
    """The first row of each key within the horizon; history beyond it is an anti-join in the batch that publishes."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def job_states(stream: DataFrame, key: str, ts: str, ok: str, order: str, threshold: int = 3, hours: int = 24) -> DataFrame:  # ST7
    """Failure streaks, quarantine and last success as a state machine a job; rows of a batch in order of (ts, order)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, success = state.get if state.exists else (0, None)
        rows = []
        for r in pd.concat(frames).sort_values(["_ts", "_order"]).itertuples(index=False):
            failures = 0 if r[1] else failures + 1
            success = r[0] if r[1] else success
            held = failures >= threshold
            rows.append((k[0], r[0], failures, "QUARANTINED" if held else "FAILED" if failures else "SUCCESS", r[0] + pd.Timedelta(hours=hours) if held else None, success))
        state.update((failures, success))
        yield pd.DataFrame(rows, columns=["source_job_key", "ts", "consecutive_failures", "status", "quarantined_until", "last_success_at"])

    shaped = stream.select(F.col(key).cast("string").alias("source_job_key"), F.col(ts).cast("timestamp").alias("_ts"), F.col(ok).alias("_ok"), F.col(order).alias("_order"))
    flat = shaped.select("_ts", "_ok", "_order", "source_job_key")
    return flat.groupBy("source_job_key").applyInPandasWithState(step, RECEIPT, STATE, "append", GroupStateTimeout.NoTimeout)


RELEASED = "RELEASED"
RELEASES = "source_job_key string, ts timestamp, consecutive_failures int, status string, quarantined_until timestamp, last_success_at timestamp"


def _instant(micros: int | None) -> dt.datetime | None:
    return None if micros is None else dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=micros)


class Quarantine(StatefulProcessor):
    """A job's failure streak with an end of its quarantine: receipts change the state as they come, and an event-time timer changes
    it when the quarantine runs out without a new receipt. Instants are microseconds here, whatever zone a session has."""

    def __init__(self, threshold: int, hours: int):
        self.threshold, self.length = threshold, hours * 3600 * 10**6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "failures int, success long, until long")

    def _row(self, key: tuple, at: int, failures: int, status: str, until: int | None, success: int | None) -> Row:
        return Row(source_job_key=key[0], ts=_instant(at), consecutive_failures=failures, status=status, quarantined_until=_instant(until), last_success_at=_instant(success))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failures, success, until = self.job.get() if self.job.exists() else (0, None, None)
        for r in sorted(rows, key=lambda r: (r["_at"], r["_order"])):
            at = r["_at"]
            if until is not None and at >= until:  # the timer would have told, had no receipt come in the same batch
                yield self._row(key, until, failures, RELEASED, None, success)
            failures = 0 if r["_ok"] else failures + 1
            success = at if r["_ok"] else success
            until = at + self.length if failures >= self.threshold else None
            yield self._row(key, at, failures, "FAILED" if 0 < failures < self.threshold else "QUARANTINED" if failures else "SUCCESS", until, success)
        self.job.update((failures, success, until))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failures, success, until = self.job.get()
        self.job.update((failures, success, None))
        if until is not None:
            yield self._row(key, until, failures, RELEASED, None, success)

    def close(self) -> None:
        pass


def quarantines(stream: DataFrame, key: str, ts: str, ok: str, order: str, threshold: int = 3, hours: int = 24, late: str = "1 hour") -> DataFrame:  # ST7
    """job_states(), and a row RELEASED at the end of each quarantine that no receipt has renewed or ended by then. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass)."""
    shaped = stream.select(F.col(key).cast("string").alias("source_job_key"), F.col(ts).cast("timestamp").alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(ok).alias("_ok"), F.col(order).alias("_order"))
    return shaped.withWatermark("_ts", late).groupBy("source_job_key").transformWithState(Quarantine(threshold, hours), RELEASES, "append", "eventTime")


#: Buckets of a history by the hash of its key: a batch reads those that its keys fall into.
BUCKETS = 64


def bucket(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def history(spark: SparkSession, path: str, key: list[str], asked: list[int]) -> DataFrame | None:  # ST2, ST3
    """The keys of a history in those buckets, each a folder of its own, so that no other file is opened; null if there is no history yet."""
    try:
        return spark.read.parquet(path).where(F.col("_bucket").isin(asked)).select(*key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def into_table(stream: DataFrame, path: str, checkpoint: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda x: x, buckets: int = BUCKETS):  # ST1, ST2, ST9
    """All that is available now, each batch appended without the keys that the table has: running it again adds nothing. A batch
    meets only the buckets of the table that its keys fall into."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = transform(batch).dropDuplicates(key).withColumn("_bucket", bucket(key, buckets)).persist()
        try:
            asked = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # `buckets` at most
            held = history(batch.sparkSession, path, key, asked) if asked else None
            new = fresh if held is None else fresh.join(held, key, "left_anti")
            if asked:
                new.write.partitionBy("_bucket").mode("append").parquet(path)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

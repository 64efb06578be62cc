"""Ranking what has not been published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import keys


def elapsed_hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def recency(now: Column, at: Column) -> Column:  # T8
    """10 for now and the future, falling to 0 in 72 hours; 0 without an instant."""
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(10.0) - F.least(F.lit(10.0), F.greatest(F.lit(0.0), elapsed_hours(now, at)) / 7.2)), F.lit(0.0))


def rank(events: DataFrame, key: str, score: str, recent: str, event_id: str, limit: int) -> DataFrame:  # T1
    """The best row of each key, then the first `limit` by score, recency and id, all descending. 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    order = [F.desc(score), F.desc(recent), F.desc(event_id)]
    return keys.best(events, [key], order, event_id).orderBy(*order).limit(limit)

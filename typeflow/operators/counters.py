"""Plain counters and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.operators.common import looking_back, of_user


def now_stats(ev: DataFrame, as_of=None, lookback="1 hour", user: str | None = None) -> DataFrame:
    """Events, corrections and finished words of the period: one row from one pass."""
    return looking_back(ev, as_of, lookback, user).agg(
        F.count("*").alias("total_count"),
        F.count_if(F.col("is_return")).alias("error_count"),
        F.count_if(F.col("is_end_of_word") | F.col("is_end_of_line")).alias("word_count"),
    )


def recent_events(
    ev: DataFrame, as_of=None, lookback="1 hour", n: int = 10, user: str | None = None
) -> DataFrame:
    """The newest ``n`` events of the period (``lookback=None``: of the whole table)."""
    return looking_back(ev, as_of, lookback, user).orderBy(F.desc("record_time"), F.desc("keystroke_id")).limit(n)


def status(kev: DataFrame) -> DataFrame:
    """Time of the last event and number of events."""
    return kev.agg(F.max("Timestamp").alias("last_event"), F.count("*").alias("event_count"))


def event_count(kev: DataFrame) -> DataFrame:
    return kev.agg(F.count("*").alias("event_count"))


def event_count_by_user(ev: DataFrame, user: str | None = None) -> DataFrame:
    """Number of events of one user; without a user, one row for each."""
    if user is None:
        return ev.groupBy("user_id").agg(F.count("*").alias("event_count"))
    return of_user(ev, user).agg(F.count("*").alias("event_count"))

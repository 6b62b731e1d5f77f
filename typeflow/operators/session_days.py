"""Session numbers without the whole history.

A session's number depends on every gap of its key before it, but only through two values: the last moment and the count
of sessions up to some date. They are kept in a table with one row per key and date, which each update extends from the
events since, so that a query of recent sessions reads the events of the last dates only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.functions.time import before, fixed_micros, ntz, resolve
from typeflow.operators.common import starting
from typeflow.operators.islands import counted_days, daily_sessions, day_gaps, day_parts, with_times
from typeflow.session import exists


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


@dataclass(frozen=True)
class SessionDays:
    """The kept table at ``path`` for sessions of ``keys`` that end at gaps above ``gap``."""

    path: str
    keys: Sequence[str] = ()
    gap: str = "3 minutes"

    def days(self, kev: DataFrame) -> DataFrame | None:
        """One row per key and date: ``first_lo``, ``last_hi`` (microseconds), ``breaks``, and ``sessions`` so far."""
        spark = kev.sparkSession
        if not exists(spark, self.path):
            return None
        columns = [f"`{name}` {dict(kev.dtypes)[name]}" for name in self.keys]
        columns += ["session_date date", "first_lo bigint", "last_hi bigint", "breaks bigint", "sessions bigint"]
        return spark.read.schema(", ".join(columns)).parquet(self.path)

    def until(self, kev: DataFrame) -> date | None:
        """The last date that is kept."""
        days = self.days(kev)
        return None if days is None else days.agg(F.max("session_date")).first()[0]

    def _before(self, kev: DataFrame, day: date) -> DataFrame | None:
        days = self.days(kev)
        if days is None:
            return None
        last = F.max(F.struct("session_date", "last_hi", "sessions")).alias("last")
        rows = days.filter(F.col("session_date") < F.lit(day)).groupBy(*self.keys).agg(last).filter("last is not null")
        return rows.select(*self.keys, "last.*")

    def update(self, kev: DataFrame, as_of=None, settled="1 day", since: date | None = None) -> None:
        """Keeps all dates that ended ``settled`` before ``as_of``, reading the events after the last kept date.

        Events that arrive for a date already kept aren't seen; ``since`` does the dates from there on again. An update
        that is repeated, or that failed half way and is repeated, writes the same dates anew.
        """
        end = before(as_of, settled).date()
        until = self.until(kev)
        first = None if until is None else until + timedelta(days=1)
        if first is not None and since is not None:
            first = min(first, since)
        new = kev.filter(F.col("Timestamp") < ntz(_midnight(end)))
        if first is not None:
            new = starting(new, "Timestamp", _midnight(first), inclusive=True)
        keys, gap = list(self.keys), fixed_micros(self.gap)
        earlier = None if first is None else self._before(kev, first)
        counted = counted_days(day_gaps(day_parts(new, keys, "Timestamp", gap), keys), keys, gap, earlier)
        # What is read here lies before the dates that are written, so other partitions stay as they are.
        counted.hint("rebalance", "session_date").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("session_date").parquet(self.path)

    def recent(self, kev: DataFrame, as_of=None, lookback="24 hours") -> DataFrame:
        """The sessions that began in the last ``lookback``, numbered over the whole history.

        Only events from the cutoff's date on are read, or from the first date that isn't kept yet, if that is earlier.
        """
        cutoff = before(resolve(as_of), lookback)
        until, first = self.until(kev), None
        if until is not None:
            first = min(cutoff.date(), until + timedelta(days=1))
            kev = starting(kev, "Timestamp", _midnight(first), inclusive=True)
        earlier = None if first is None else self._before(kev, first)
        sessions = daily_sessions(kev, self.keys, "Timestamp", fixed_micros(self.gap), earlier=earlier)
        return (
            with_times(sessions)
            .filter(F.col("session_start") > ntz(cutoff))
            .orderBy(*self.keys, F.desc("session_date"), "session_number")
        )

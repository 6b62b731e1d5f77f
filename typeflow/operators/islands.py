"""Runs of events without a long gap, found without sorting the events.

A run ends where the next event of its key is more than ``gap`` later. Cut time into slices no wider than the gap:
two events of one slice are never more than a gap apart, so the order inside a slice cannot matter and a slice is
fully described by its first time, last time and counts. That is an ordinary hash aggregation: it combines on the
map side, so a key holding a large share of all events reaches the shuffle as one row per slice and task, and what
a later window sorts for one key is bounded by (length of history / gap), whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.functions.time import floor_to, from_micros, micros
from typeflow.operators.common import join_same


def day_divisor(gap: int) -> int:
    """The longest length up to ``gap`` (at least a microsecond) that divides a day."""
    # A day has 2^13 * 3^3 * 5^8 microseconds.
    divisors = (2**a * 3**b * 5**c for a in range(14) for b in range(4) for c in range(9))
    return max(d for d in divisors if d <= max(gap, 1))


def slices(
    df: DataFrame,
    keys: Sequence[str],
    us: Column,
    gap: int,
    origin: int = 0,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per (keys, slice): ``lo`` and ``hi`` in microseconds, ``n`` events, and further aggregates."""
    width = max(gap, 1)
    return (
        df.withColumn("_us", us)
        .filter(F.col("_us").isNotNull())
        .groupBy(*keys, floor_to(F.col("_us"), width, origin).alias("slice"))
        .agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.count("*").alias("n"), *extra)
    )


def day_parts(df: DataFrame, keys: Sequence[str], ts: str, gap: int) -> DataFrame:
    """Each date's runs per key: ``part`` counts from 0, ``lo`` and ``hi`` in microseconds.

    Inside a date the boundaries depend on that date's events only, so dates are handled on their own.
    """
    # No slice reaches over midnight, so a slice knows its date.
    pieces = slices(df, keys, micros(ts), day_divisor(gap)).withColumn(
        "session_date", F.to_date(from_micros(F.col("slice")))
    )
    day = Window.partitionBy(*keys, "session_date").orderBy("lo")
    return (
        pieces.withColumn("opens", F.coalesce(F.col("lo") - F.lag("hi").over(day) > F.lit(gap), F.lit(False)))
        .withColumn("part", F.sum(F.col("opens").cast("long")).over(day))
        .groupBy(*keys, "session_date", "part")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )


def day_gaps(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the days around need to know of a key's date: its first and last moment and the gaps between."""
    return parts.groupBy(*keys, "session_date").agg(
        F.min("lo").alias("first_lo"), F.max("hi").alias("last_hi"), F.max("part").alias("breaks")
    )


def counted_days(dates: DataFrame, keys: Sequence[str], gap: int, earlier: DataFrame | None = None) -> DataFrame:
    """:func:`day_gaps` with ``sessions``, the key's sessions up to the end of the date.

    ``earlier`` holds ``session_date``, ``last_hi`` and ``sessions`` of the last date before these, for keys that have one.
    """
    history = Window.partitionBy(*keys).orderBy("session_date")
    new = F.coalesce(F.col("first_lo") - F.lag("last_hi").over(history) > F.lit(gap), F.lit(True)).cast("long") + F.col("breaks")
    if earlier is not None:
        dates = dates.unionByName(earlier, allowMissingColumns=True)
        new = F.coalesce("sessions", new)
    counted = dates.withColumn("new", new).withColumn("total", F.sum("new").over(history))
    if earlier is not None:
        counted = counted.filter("sessions is null").drop("sessions")
    return counted.drop("new").withColumnRenamed("total", "sessions")


def daily_sessions(
    df: DataFrame, keys: Sequence[str], ts: str, gap: int, numbered: bool = True, earlier: DataFrame | None = None
) -> DataFrame:
    """Sessions per key and date, in microseconds (``lo``, ``hi``), with the key's running ``session_number``.

    A session that goes on over midnight is split by date and keeps its number. The numbers need one more step over a
    table of one row per key and date; ``earlier`` stands for the dates before ``df`` (see :func:`counted_days`).
    """
    keys = list(keys)
    parts = day_parts(df, keys, ts, gap)
    if not numbered:
        return parts.drop("part")
    numbers = counted_days(day_gaps(parts, keys), keys, gap, earlier).select(
        *keys, "session_date", (F.col("sessions") - F.col("breaks")).alias("before")
    )
    return join_same(parts, numbers, [*keys, "session_date"]).select(
        *keys, "session_date", (F.col("before") + F.col("part")).alias("session_number"), "lo", "hi"
    )


def with_times(sessions: DataFrame) -> DataFrame:
    """Session times as timestamps and ``duration`` in seconds; sessions of a single moment are left out."""
    kept = [name for name in sessions.columns if name not in ("lo", "hi")]
    return sessions.filter(F.col("hi") > F.col("lo")).select(
        *kept,
        from_micros(F.col("lo")).alias("session_start"),
        from_micros(F.col("hi")).alias("session_end"),
        ((F.col("hi") - F.col("lo")) / F.lit(1e6)).alias("duration"),
    )

"""When people type: weekdays, times of day, active days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.functions.text import clock_label
from typeflow.functions.time import (
    DAY,
    MINUTE,
    bin_in_day,
    fixed_micros,
    from_micros,
    hour_part,
    micros,
    minute_of_day,
    minute_part,
    span,
    weekday_name,
)
from typeflow.operators.common import looking_back


def weekday_number(ts: str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(ts) - F.lit(1)


def day_of_week(
    ev: DataFrame, as_of=None, lookback="1 month", user: str | None = None, padded: bool = False
) -> DataFrame:
    """Events per weekday, Sunday first. ``lookback=None`` takes the whole history."""
    return (
        looking_back(ev, as_of, lookback, user)
        .groupBy(weekday_number("record_time").alias("dow"))
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.asc_nulls_last("dow"))
        .select(weekday_name(F.col("dow"), padded).alias("day_of_week"), "event_count")
    )


def _bucket_minute(width: str) -> Column:
    return minute_of_day(bin_in_day(micros("record_time"), fixed_micros(width)))


def _daily_counts(ev: DataFrame, width: str) -> DataFrame:
    """Events per day and bucket of the day; a bucket is named by the minute it starts in."""
    return ev.groupBy(F.to_date("record_time").alias("day"), _bucket_minute(width).alias("bucket")).agg(
        F.count("*").alias("n")
    )


def _clock(df: DataFrame, *values: str | Column) -> DataFrame:
    bucket = F.col("bucket")
    return df.orderBy(F.asc_nulls_last("bucket")).select(
        hour_part(bucket).alias("hour"), minute_part(bucket).alias("minute"), *values
    )


def _bucket_spine(ev: DataFrame, width: str) -> DataFrame:
    """Every bucket of a day: at most 1440 rows, since a bucket is named by its minute."""
    step = fixed_micros(width)
    if step >= MINUTE:
        starts = F.col("id") * F.lit(step)
        count = -(-DAY // step)
    else:
        starts = F.col("id") * F.lit(MINUTE)
        count = DAY // MINUTE
    return ev.sparkSession.range(0, count, 1, 1).select(minute_of_day(starts).alias("bucket"))


def _averages(ev: DataFrame, width: str, name: str) -> DataFrame:
    return _daily_counts(ev, width).groupBy("bucket").agg(F.avg("n").alias(name))


def time_of_day(
    ev: DataFrame, as_of=None, lookback="1 month", width: str = "1 hour", user: str | None = None
) -> DataFrame:
    """Mean events per bucket of the day, over the days that have events in the bucket."""
    return _clock(_averages(looking_back(ev, as_of, lookback, user), width, "strokes_count"), "strokes_count")


def time_of_day_labelled(
    ev: DataFrame, as_of=None, lookback="1 week", width: str = "1 hour", user: str | None = None
) -> DataFrame:
    """As :func:`time_of_day` with one 'HH:MM' column."""
    clock = _clock(_averages(looking_back(ev, as_of, lookback, user), width, "typing_count"), "typing_count")
    return clock.select(clock_label(F.col("hour"), F.col("minute")).alias("time_of_day"), "typing_count")


def _totals(ev: DataFrame, width: str) -> DataFrame:
    return ev.groupBy(_bucket_minute(width).alias("bucket")).agg(F.count("*").alias("strokes_count"))


def time_of_day_total(ev: DataFrame, width: str = "15 minutes") -> DataFrame:
    """All events per bucket of the day; empty buckets are missing."""
    return _clock(_totals(ev, width), "strokes_count")


def time_of_day_total_dense(ev: DataFrame, width: str = "15 minutes") -> DataFrame:
    """All events per bucket of the day, 0 for empty buckets."""
    filled = _bucket_spine(ev, width).join(_totals(ev, width), "bucket", "left")
    return _clock(filled, F.coalesce("strokes_count", F.lit(0)).cast("long").alias("strokes_count"))


def time_of_day_dense(ev: DataFrame, width: str = "15 minutes", full_last_day: bool = False) -> DataFrame:
    """Mean events per bucket of the day over all days from the first to the last, days without events included.

    By default the last day takes part with its first bucket only (the day series stops at its midnight);
    ``full_last_day`` counts it whole. No day-by-bucket grid is built: the number of days a bucket is averaged over
    follows from the first and last day, and the totals from one aggregation.
    """
    if DAY % fixed_micros(width):
        raise ValueError("the width must divide a day")
    buckets = (
        _daily_counts(ev.filter(F.col("record_time").isNotNull()), width)
        .groupBy("bucket")
        .agg(
            F.sum("n").alias("total"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.max_by("n", "day").alias("n_last_day"),
        )
    )
    # At most 1440 rows from here on, so the ungrouped window is bounded.
    everything = Window.partitionBy(F.lit(0))
    filled = (
        _bucket_spine(ev, width)
        .join(buckets, "bucket", "left")
        .withColumn("first", F.min("first_day").over(everything))
        .withColumn("last", F.max("last_day").over(everything))
    )
    days = F.date_diff("last", "first") + F.lit(1)
    total = F.coalesce("total", F.lit(0))
    if not full_last_day:
        cut = F.col("bucket") != 0
        lost = F.when(cut & (F.col("last_day") == F.col("last")), F.col("n_last_day")).otherwise(F.lit(0))
        total = total - lost
        days = F.when(cut, days - F.lit(1)).otherwise(days)
    averaged = filled.withColumn("days", days).filter(F.col("days") > 0)
    return _clock(averaged, (total / F.col("days")).alias("strokes_count"))


def activity_range(ev: DataFrame) -> DataFrame:
    """First and last day with events."""
    day = F.to_date("record_time").cast("timestamp_ntz")
    return ev.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def time_grid(df: DataFrame, end: str, step: str, n: int, name: str = "time_of_day") -> DataFrame:
    """For each row the times from ``end - n * step`` on, step by step, up to ``end``.

    Steps of months go from one time to the next, so a day of month lost to a short month stays lost, and ``end`` is
    reached only if none is.
    """
    length = span(step)
    if length.fixed:
        us = micros(end)
        stamps = F.sequence(us - F.lit(n * length.micros), us, F.lit(length.micros).cast("long"))
        return df.select("*", F.explode(F.transform(stamps, from_micros)).alias(name))
    if length.micros:
        raise ValueError("the step must be months or a fixed length, not both")
    start = F.col(end) - F.make_ym_interval(F.lit(0), F.lit(n * length.months))
    month_step = F.make_ym_interval(F.lit(0), F.lit(length.months))
    stamps = F.aggregate(
        F.sequence(F.lit(1), F.lit(n)),
        F.array(start),
        lambda done, _: F.array_append(done, F.element_at(done, -1) + month_step),
    )
    return df.select("*", F.explode(F.filter(stamps, lambda t: t <= F.col(end))).alias(name))

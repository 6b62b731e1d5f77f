"""Reports made of several tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.functions.text import clock_label, host
from typeflow.functions.time import (
    bin_in_day,
    fixed_micros,
    hour_part,
    micros,
    minute_of_day,
    minute_part,
    ntz,
    resolve,
    shift,
    span,
    weekday_name,
)
from typeflow.operators.common import of_user, starting
from typeflow.operators.flows import typing_speed
from typeflow.operators.rhythm import time_of_day_labelled, weekday_number
from typeflow.operators.sites import top_sites

HORIZONS = ("Current", "Previous")


def _horizon(as_of) -> Column:
    now = resolve(as_of)
    week, two_weeks = (ntz(shift(now, span(s), -1)) for s in ("1 week", "2 weeks"))
    time = F.col("record_time")
    return F.when(time > week, "Current").when(time.between(two_weeks, week), "Previous")


def _two_weeks(ev: DataFrame, as_of, user: str | None) -> DataFrame:
    now = resolve(as_of)
    recent = starting(of_user(ev, user), "record_time", shift(now, span("2 weeks"), -1), inclusive=True)
    return recent.withColumn("horizon", _horizon(now)).withColumn("dow", weekday_number("record_time"))


def week_over_week(ev: DataFrame, as_of=None, user: str | None = None, padded: bool = False) -> DataFrame:
    """Events per weekday in the last week and the one before, in one pass over both weeks."""
    return (
        _two_weeks(ev, as_of, user)
        .groupBy("horizon", "dow")
        .agg(F.min("record_time").alias("start_date"), F.count("*").alias("event_count"))
        .orderBy("horizon", "dow")
        .select("horizon", weekday_name(F.col("dow"), padded).alias("day_of_week"), "start_date", "event_count")
    )


def week_over_week_pivot(ev: DataFrame, as_of=None, user: str | None = None) -> DataFrame:
    """One row per weekday with both weeks side by side; NULL where a week has no event on it."""
    return (
        _two_weeks(ev, as_of, user)
        .groupBy("dow")
        .pivot("horizon", list(HORIZONS))
        .agg(F.count(F.lit(1)))
        .orderBy("dow")
        .select(weekday_name(F.col("dow")).alias("day_of_week"), *[F.col(h).alias(h.lower()) for h in HORIZONS])
    )


def weekly_report(ev: DataFrame, as_of=None, user: str | None = None) -> dict[str, DataFrame]:
    """The tables of the weekly report, by name."""
    now = resolve(as_of)
    return {
        "week_over_week": week_over_week(ev, now, user),
        "top_sites": top_sites(ev, now, "1 week", 10, user),
        "time_of_day": time_of_day_labelled(ev, now, "1 week", "1 hour", user),
    }


def weekly_report_rows(ev: DataFrame, as_of=None, user: str | None = None) -> DataFrame:
    """The weekly report as one table of (section, series, label, value), from one scan.

    Every event of both weeks gives a tagged row for each section it counts in, and all sections are counted together;
    what is left to do (the ten top sites, means over days) starts from these counts.
    """
    now = resolve(as_of)
    this_week, nothing = F.col("horizon") == "Current", F.lit(None).cast("string")
    hour = bin_in_day(micros("record_time"), fixed_micros("1 hour"))

    def tagged(section: str, when: Column | None = None, series: Column = nothing, label: Column = nothing, us: Column | None = None):
        row = F.struct(
            F.lit(section).alias("section"),
            series.alias("series"),
            label.alias("label"),
            (F.lit(None) if us is None else us).cast("bigint").alias("us"),
        )
        return row if when is None else F.when(when, row)

    site = host("source_url")
    tags = F.array_compact(
        F.array(
            tagged("week_over_week", None, F.col("horizon"), weekday_name(F.col("dow"))),
            tagged("top_sites", this_week & site.isNotNull(), label=site),
            tagged("time_of_day", this_week, us=hour),
        )
    )
    counts = (
        _two_weeks(ev, now, user)
        .select(F.explode(tags).alias("tag"))
        .groupBy("tag.section", "tag.series", "tag.label", "tag.us")
        .agg(F.count("*").alias("n"))
    )
    minute = minute_of_day(F.col("us"))
    clock = clock_label(hour_part(minute), minute_part(minute))
    mean = F.when(F.col("section") == "time_of_day", F.avg("n")).otherwise(F.sum("n").cast("double"))
    rows = counts.groupBy("section", "series", F.coalesce("label", clock).alias("label")).agg(mean.alias("value"))
    # Only sites compete for places; any other row is alone with its own.
    alone = F.when(F.col("section") != "top_sites", F.struct("series", "label"))
    places = Window.partitionBy("section", alone).orderBy(F.desc("value"), "label")
    return rows.withColumn("place", F.row_number().over(places)).filter(F.col("place") <= 10).drop("place")


def write_weekly_report(ev: DataFrame, folder: str, as_of=None, user: str | None = None, fmt: str = "parquet") -> None:
    """Write each table of the weekly report below ``folder``, as parquet or JSON records."""
    for name, table in weekly_report(ev, as_of, user).items():
        table.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


# The periods the dashboard offers; others may be given too.
PERIODS = ("3 months", "1 month", "2 weeks", "1 week", "1 day", "12 hours")


def insights(ev: DataFrame, as_of=None, period: str = "1 week", user: str | None = None, **speed) -> dict[str, DataFrame]:
    """Dashboard tables for a period, any interval: top sites, and the typing series from the oldest window on."""
    now = resolve(as_of)
    series = typing_speed(ev, now, period, user=user, newest_first=False, **speed)
    return {
        "top_sites": top_sites(ev, now, period, 10, user),
        "typing": series.select("user_id", "window_start", "event_count", "relative_error", "speed"),
    }

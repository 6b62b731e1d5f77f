"""Sessions and active time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.functions.text import duration_text
from typeflow.functions.time import (
    Span,
    before,
    epoch_micros,
    fixed_micros,
    from_micros,
    micros,
    ntz,
    resolve,
    shift,
    since_now,
    weekday_name,
)
from typeflow.operators.common import looking_back, starting
from typeflow.operators.islands import daily_sessions, slices, with_times
from typeflow.operators.rhythm import weekday_number


def active_sessions_by_app(kev: DataFrame, gap="10 minutes", keys: Sequence[str] = ("App",)) -> DataFrame:
    """Sessions per app and date: number, start, end and seconds. ``keys`` may add a device or user."""
    sessions = with_times(daily_sessions(kev, keys, "Timestamp", fixed_micros(gap)))
    return sessions.orderBy(*keys, F.desc("session_date"), "session_number")


def active_sessions(
    kev: DataFrame, as_of=None, gap="3 minutes", lookback="24 hours", keys: Sequence[str] = ()
) -> DataFrame:
    """Sessions over all apps that began in the last ``lookback``, numbered over the whole history.

    Without ``as_of`` the cutoff is taken anew whenever the result is computed, so a view of it stays current.
    """
    sessions = with_times(daily_sessions(kev, keys, "Timestamp", fixed_micros(gap)))
    cutoff = since_now(lookback) if as_of is None else ntz(before(as_of, lookback))
    return sessions.filter(F.col("session_start") > cutoff).orderBy(
        *keys, F.desc("session_date"), "session_number"
    )


def _unnumbered(kev: DataFrame, keys: Sequence[str], gap: str, since: datetime | None = None) -> DataFrame:
    """Sessions without numbers. They are split by date, so ``since`` needs the events of its own date on."""
    if since is not None:
        kev = starting(kev, "Timestamp", datetime(since.year, since.month, since.day), inclusive=True)
    sessions = with_times(daily_sessions(kev, keys, "Timestamp", fixed_micros(gap), numbered=False))
    return sessions if since is None else sessions.filter(F.col("session_start") > ntz(since))


def active_time_by_app(kev: DataFrame, gap="10 minutes") -> DataFrame:
    """Active seconds per app, most active first."""
    return (
        _unnumbered(kev, ["App"], gap)
        .groupBy("App")
        .agg(F.sum("duration").alias("total_time"))
        .orderBy(F.desc("total_time"), "App")
    )


def recent_sessions_by_app(
    kev: DataFrame, as_of=None, lookback="24 hours", gap="10 minutes", as_text: bool = False
) -> DataFrame:
    """App, start and end of the sessions that began in the last ``lookback``, for a time chart."""
    rows = _unnumbered(kev, ["App"], gap, before(as_of, lookback))
    start, end = F.col("session_start"), F.col("session_end")
    if as_text:
        start, end = start.cast("string"), end.cast("string")
    return rows.select("App", start.alias("session_start"), end.alias("session_end"))


def recent_sessions_in_full(kev: DataFrame, as_of=None, lookback="3 hours", gap="10 minutes") -> DataFrame:
    """All session columns of the sessions per app that began in the last ``lookback``."""
    return active_sessions_by_app(kev, gap).filter(F.col("session_start") > ntz(before(as_of, lookback)))


def total_active_time(kev: DataFrame, as_of=None, gap="3 minutes", lookback="24 hours") -> DataFrame:
    """Seconds of all recent sessions together, and the same as text."""
    total = F.coalesce(F.sum("duration"), F.lit(0.0))
    return (
        _unnumbered(kev, [], gap, before(as_of, lookback))
        .agg(total.alias("total_seconds"))
        .withColumn("total_text", duration_text(F.col("total_seconds")))
    )


def session_apps(kev: DataFrame, gap="10 minutes", as_of=None, lookback: str | None = None) -> DataFrame:
    """Apps that have sessions, or sessions that began in the last ``lookback``: the rows of a time chart."""
    since = None if lookback is None else before(as_of, lookback)
    return _unnumbered(kev, ["App"], gap, since).select("App").distinct()


def session_extent(kev: DataFrame, gap="10 minutes", as_of=None, lookback: str | None = None) -> DataFrame:
    """First start and last end over all sessions, or those that began in the last ``lookback``: the ends of a time axis."""
    since = None if lookback is None else before(as_of, lookback)
    return _unnumbered(kev, ["App"], gap, since).agg(
        F.min("session_start").alias("first_start"), F.max("session_end").alias("last_end")
    )


def session_times(
    ev: DataFrame, as_of=None, lookback="1 month", gap="3 minutes", user: str | None = None, padded: bool = False
) -> DataFrame:
    """Hours, minutes, sessions and median session length per user and date.

    A session is reported on the date of the event that follows the pause after it; the newest event reports a
    session of its own while it is younger than the pause. A user's first event alone reports nothing.
    """
    now = resolve(as_of)
    gap_us, now_us = fixed_micros(gap), epoch_micros(now)
    width = max(gap_us, 1)
    recent = looking_back(ev, now, lookback, user)

    # Slices are counted from as_of, so that the events young enough for an open session fill whole slices.
    history = "(partition by user_id order by lo)"
    pieces = slices(recent, ["user_id"], micros("record_time"), width, now_us).selectExpr(
        "*", f"lag(hi) over {history} as before_lo", f"lead(lo) over {history} is null as newest"
    )

    # The event before a user's newest one, where both are in these slices. Two rows per user and task are shuffled.
    latest = "(partition by user_id order by record_time desc, keystroke_id desc)"
    second = (
        starting(recent, "record_time", shift(now, Span(0, width), -1), inclusive=True)
        .select("user_id", "record_time", "keystroke_id")
        .withColumn("newest_rank", F.expr(f"row_number() over {latest}"))
        .filter("newest_rank = 2")
        .select("user_id", micros("record_time").alias("second_us"))
    )

    # A slice reports the session before the pause ahead of it; the newest one also a session that is still open.
    after_pause = f"coalesce(lo - before_lo > {gap_us}, false)"
    still_open = f"newest and {now_us} - hi < {gap_us}"
    reports = f"""explode(array_compact(array(
        if({after_pause}, named_struct('us', lo, 'end_us', before_lo, 'open', 0), null),
        if({still_open} and not ({after_pause} and n = 1),
           named_struct('us', hi, 'end_us', coalesce(second_us, before_lo), 'open', 1), null)))) as report"""
    boundaries = (
        pieces.join(second, "user_id", "left")
        .selectExpr("user_id", reports)
        .selectExpr(
            "user_id",
            "report.us",
            "report.end_us",
            "report.end_us - lag(report.us) over (partition by user_id order by report.us, report.open) as length_us",
        )
        .withColumn("session_date", F.to_date(from_micros(F.col("us"))))
    )
    seconds = F.sum("length_us") / F.lit(1e6)
    minutes = F.col("length_us") / F.lit(6e7)
    name = weekday_name(weekday_number("session_date"), padded, lower=True)
    return (
        boundaries.groupBy("user_id", "session_date")
        .agg(
            F.coalesce(seconds / F.lit(3600), F.lit(0.0)).alias("total_hours"),
            F.coalesce(seconds / F.lit(60), F.lit(0.0)).alias("total_minutes"),
            F.sum("length_us").alias("total_us"),
            F.count("*").alias("number_of_sessions"),
            F.coalesce(F.percentile(minutes, F.lit(0.5)), F.lit(0.0)).alias("median_session_duration"),
            F.max("end_us").alias("end_us"),
        )
        .select(
            name.alias("day_of_week"),
            "user_id",
            "session_date",
            "total_hours",
            "total_minutes",
            F.make_dt_interval(secs=(F.col("total_us") / F.lit(1e6)).cast("decimal(20,6)")).alias("total_time"),
            "number_of_sessions",
            "median_session_duration",
            from_micros(F.col("end_us")).alias("sessions_end"),
        )
        .orderBy(F.desc("session_date"), "user_id")
    )

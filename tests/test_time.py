from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from typeflow.functions.time import (
    DAY,
    HOUR,
    MINUTE,
    SECOND,
    Span,
    bin_in_day,
    epoch_micros,
    floor_to,
    from_micros,
    micros,
    milliseconds,
    minute_of_day,
    resolve,
    shift,
    span,
    weekday_name,
)
from typeflow.session import use_utc


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("15 minutes", Span(0, 15 * MINUTE)),
        ("6 hours", Span(0, 6 * HOUR)),
        ("1 month", Span(1, 0)),
        ("3 months", Span(3, 0)),
        ("2 weeks", Span(0, 14 * DAY)),
        ("1 day", Span(0, DAY)),
        ("12 hours", Span(0, 12 * HOUR)),
        ("1 hour 30 minutes", Span(0, 90 * MINUTE)),
        ("1 year 2 days", Span(12, 2 * DAY)),
        ("0.5 seconds", Span(0, SECOND // 2)),
    ],
)
def test_intervals_are_read_from_text(text, expected):
    assert span(text) == expected


@pytest.mark.parametrize("text", ["", "soon", "5", "5 parsecs", "1.5 months", "1 day; drop"])
def test_other_text_is_refused(text):
    with pytest.raises(ValueError):
        span(text)


def test_month_steps_clamp():
    assert shift(datetime(2024, 3, 31, 5), span("1 month"), -1) == datetime(2024, 2, 29, 5)
    assert shift(datetime(2024, 1, 31), span("1 month")) == datetime(2024, 2, 29)
    assert shift(datetime(2024, 1, 15), span("13 months"), -1) == datetime(2022, 12, 15)


def test_as_of_is_zone_less_utc():
    assert resolve("2024-01-01T02:00:00+02:00") == datetime(2024, 1, 1)
    assert abs(resolve(None) - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(minutes=1)


def test_micros_are_exact_before_and_after_the_epoch(spark):
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 13, 47, 1, 123457)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    us = micros("t")
    got = df.select(
        us.alias("us"), from_micros(us).alias("back"), from_micros(bin_in_day(us, 15 * MINUTE)).alias("bin"),
        minute_of_day(us).alias("minute"), floor_to(us, 7 * SECOND, 3).alias("floor"),
    ).collect()
    for row, t in zip(got, times):
        assert row.us == epoch_micros(t) and row.back == t
        assert row.bin == t.replace(minute=t.minute // 15 * 15, second=0, microsecond=0)
        assert row.minute == t.hour * 60 + t.minute
        assert row.floor <= row.us < row.floor + 7 * SECOND and (row.floor - 3) % (7 * SECOND) == 0


def test_other_session_zones_are_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(RuntimeError):
            micros("t")
        use_utc(spark)
        micros("t")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_milliseconds_take_the_seconds_field(spark):
    row = spark.range(1).select(
        milliseconds(F.lit(65_123_900)).alias("field"), milliseconds(F.lit(65_123_900), "elapsed").alias("elapsed")
    ).first()
    assert (row.field, row.elapsed) == (5123.9, 65123.9)


def test_weekday_names(spark):
    row = spark.range(1).select(
        weekday_name(F.lit(0)).alias("a"), weekday_name(F.lit(6), padded=True, lower=True).alias("b")
    ).first()
    assert (row.a, row.b) == ("Sunday", "saturday ")

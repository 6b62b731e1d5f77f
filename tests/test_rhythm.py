import random
from datetime import datetime, timedelta

import pytest

from tests import naive
from tests.conftest import AS_OF
from tests.rows import same_rows
from typeflow.operators.rhythm import (
    activity_range,
    day_of_week,
    time_grid,
    time_of_day,
    time_of_day_dense,
    time_of_day_labelled,
    time_of_day_total,
    time_of_day_total_dense,
)

MONDAY = datetime(2024, 3, 4)


def spread(seed, days=5, count=300):
    rng = random.Random(seed)
    return [{"t": MONDAY + timedelta(seconds=rng.randrange(days * 86_400)), "user": rng.choice("ab")} for _ in range(count)]


def clock(df):
    return [(r.hour, r.minute, r.strokes_count) for r in df.collect()]


def test_weekdays_from_sunday(events):
    ev = events([{"t": MONDAY - timedelta(days=1)}, {"t": MONDAY}, {"t": MONDAY}, {"t": MONDAY + timedelta(days=5)}])
    rows = [(r.day_of_week, r.event_count) for r in day_of_week(ev, AS_OF).collect()]
    assert rows == [("Sunday", 1), ("Monday", 2), ("Saturday", 1)]
    assert [r.day_of_week for r in day_of_week(ev, lookback=None, padded=True).collect()] == [
        "Sunday   ",
        "Monday   ",
        "Saturday ",
    ]


def test_lookback_is_strict(events):
    ev = events([{"t": AS_OF - timedelta(hours=1)}, {"t": AS_OF - timedelta(minutes=59)}])
    assert [r.event_count for r in day_of_week(ev, AS_OF, "1 hour").collect()] == [1]


def test_days_without_events_do_not_count(events):
    ev = events([{"t": MONDAY}] * 3 + [{"t": MONDAY + timedelta(days=4)}])
    assert clock(time_of_day(ev, AS_OF)) == [(0, 0, 2.0)]


def test_width_and_label(events):
    ev = events([{"t": MONDAY + timedelta(hours=9, minutes=m)} for m in (0, 14, 15, 59)])
    assert clock(time_of_day(ev, AS_OF, width="15 minutes")) == [(9, 0, 2.0), (9, 15, 1.0), (9, 45, 1.0)]
    row = time_of_day_labelled(ev, AS_OF).first()
    assert (row.time_of_day, row.typing_count) == ("09:00", 4.0)


def test_width_that_does_not_divide_a_day_restarts_at_midnight(events):
    ev = events([{"t": MONDAY + timedelta(hours=23, minutes=59)}, {"t": MONDAY + timedelta(days=1, minutes=1)}])
    assert clock(time_of_day_total(ev, "7 hours")) == [(0, 0, 1), (21, 0, 1)]
    assert [(h, m) for h, m, _ in clock(time_of_day_total_dense(ev, "7 hours"))] == [(0, 0), (7, 0), (14, 0), (21, 0)]


@pytest.mark.parametrize("width", ["15 minutes", "1 hour", "30 seconds"])
def test_totals_sum_up(events, width):
    ev = events(spread(1)).cache()
    total, dense = clock(time_of_day_total(ev, width)), clock(time_of_day_total_dense(ev, width))
    assert sum(n for *_, n in total) == ev.count()
    assert [row for row in dense if row[2]] == total
    assert len(dense) == {"15 minutes": 96, "1 hour": 24, "30 seconds": 1440}[width]


@pytest.mark.parametrize("seed", range(2))
def test_dense_mean_equals_the_grid_form(events, seed):
    ev = events(spread(seed)).cache()
    same_rows(time_of_day_dense(ev), naive.time_of_day_dense(ev), ["hour", "minute", "strokes_count"])


def test_dense_mean_of_the_last_day(events):
    ev = events([{"t": MONDAY}, {"t": MONDAY + timedelta(hours=5)}] + [{"t": MONDAY + timedelta(days=1, hours=h)} for h in (0, 5)])
    values = {(h, m): n for h, m, n in clock(time_of_day_dense(ev, "1 hour"))}
    assert len(values) == 24 and values[0, 0] == 1.0 and values[5, 0] == 1.0 and values[6, 0] == 0.0
    full = {(h, m): n for h, m, n in clock(time_of_day_dense(ev.limit(2), "1 hour", full_last_day=True))}
    assert full[0, 0] == 1.0 and full[5, 0] == 1.0
    assert clock(time_of_day_dense(ev.limit(2), "1 hour")) == [(0, 0, 1.0)]
    assert clock(time_of_day_dense(ev.limit(0))) == []


def test_activity_range(events):
    row = activity_range(events(spread(3))).first()
    assert row.first_date == MONDAY and row.last_date == MONDAY + timedelta(days=4)


def test_time_grid_is_inclusive(spark):
    df = spark.createDataFrame([(1, datetime(2024, 3, 31, 12))], "id int, ts timestamp_ntz")
    stamps = [r.time_of_day for r in time_grid(df, "ts", "15 minutes", 4).collect()]
    assert stamps == [datetime(2024, 3, 31, 11) + timedelta(minutes=15 * k) for k in range(5)]
    months = [r.time_of_day for r in time_grid(df, "ts", "1 month", 1).collect()]
    assert months[0] == datetime(2024, 2, 29, 12)

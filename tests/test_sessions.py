import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests import naive
from tests.conftest import AS_OF
from tests.rows import same_rows
from typeflow.functions.time import fixed_micros, from_micros
from typeflow.operators.islands import daily_sessions, day_divisor
from typeflow.operators.sessions import (
    active_sessions,
    active_sessions_by_app,
    active_time_by_app,
    recent_sessions_by_app,
    recent_sessions_in_full,
    session_apps,
    session_extent,
    session_times,
    total_active_time,
)

DAY = datetime(2024, 3, 9)


def at(*minutes, app="Editor"):
    return [(DAY + timedelta(minutes=m), app) for m in minutes]


def test_gap_of_exactly_the_threshold_goes_on(keys):
    rows = active_sessions_by_app(keys(at(0, 10, 20, 31, 32))).collect()
    assert [(r.session_number, r.duration) for r in rows] == [(1, 1200.0), (2, 60.0)]


def test_single_key_sessions_vanish_but_are_numbered(keys):
    rows = active_sessions_by_app(keys(at(0, 1, 20, 40, 41))).collect()
    assert [r.session_number for r in rows] == [1, 3]


def test_session_over_midnight_is_split_and_keeps_its_number(keys):
    rows = active_sessions_by_app(keys(at(0, 1, 1435, 1439, 1441, 1444, 1500, 1501))).collect()
    assert [(r.session_date.day, r.session_number, r.duration) for r in rows] == [
        (10, 2, 180.0),
        (10, 3, 60.0),
        (9, 1, 60.0),
        (9, 2, 240.0),
    ]


def test_apps_have_their_own_sessions(keys):
    kev = keys(at(0, 2, 4) + at(1, 3, app="Mail") + at(5, 6, app=None))
    rows = active_sessions_by_app(kev).collect()
    assert {(r.App, r.session_number, r.duration) for r in rows} == {
        ("Editor", 1, 240.0),
        ("Mail", 1, 120.0),
        (None, 1, 60.0),
    }
    assert {(r.App, r.total_time) for r in active_time_by_app(kev).collect()} == {
        ("Editor", 240.0),
        ("Mail", 120.0),
        (None, 60.0),
    }
    assert {r.App for r in session_apps(kev).collect()} == {"Editor", "Mail", None}
    extent = session_extent(kev).first()
    assert (extent.first_start, extent.last_end) == (DAY, DAY + timedelta(minutes=6))


def test_apps_and_extent_of_recent_sessions(keys):
    kev = keys(at(0, 2) + at(1500, 1503, app="Mail") + at(1600, app="Once") + at(1501, 1502, app=None))
    recent = {"as_of": DAY + timedelta(minutes=1600), "lookback": "3 hours"}
    assert {r.App for r in session_apps(kev, **recent).collect()} == {"Mail", None}
    extent = session_extent(kev, **recent).first()
    assert (extent.first_start, extent.last_end) == (DAY + timedelta(minutes=1500), DAY + timedelta(minutes=1503))
    nothing = session_extent(kev, as_of=DAY + timedelta(days=9), lookback="1 hour").first()
    assert (nothing.first_start, nothing.last_end) == (None, None)


def test_overall_sessions_cross_apps_and_filter_after_numbering(keys):
    kev = keys(at(0, 3) + at(6, app="Mail") + at(10, 11) + at(1500, 1501))
    rows = active_sessions(kev, DAY + timedelta(hours=25, minutes=30)).collect()
    assert [(r.session_number, r.duration) for r in rows] == [(3, 60.0)]
    every = active_sessions(kev, DAY, lookback="1 day").collect()
    assert [r.session_number for r in every] == [3, 1, 2]
    assert every[1].duration == 360.0


def test_recent_sessions_look_at_their_start(keys):
    kev = keys(at(0, 5, 100, 101, 130, 131))
    now = DAY + timedelta(minutes=200)
    rows = recent_sessions_by_app(kev, now, "2 hours", as_text=True).collect()
    assert [(r.session_start, r.session_end) for r in rows] == [
        ("2024-03-09 01:40:00", "2024-03-09 01:41:00"),
        ("2024-03-09 02:10:00", "2024-03-09 02:11:00"),
    ]
    assert [r.session_number for r in recent_sessions_in_full(kev, now, "2 hours").collect()] == [2, 3]
    yesterday = keys(at(-5, -1, 3))
    assert recent_sessions_by_app(yesterday, DAY + timedelta(minutes=2), "5 minutes").count() == 0


def test_total_active_time(keys):
    kev = keys(at(*range(0, 61, 2)) + [(DAY + timedelta(hours=2), "a"), (DAY + timedelta(hours=2, seconds=63), "b")])
    row = total_active_time(kev, DAY + timedelta(hours=20)).first()
    assert (row.total_seconds, row.total_text) == (3663.0, "1h 1min 3s")
    none = total_active_time(kev, DAY + timedelta(days=9)).first()
    assert (none.total_seconds, none.total_text) == (0.0, "")


@pytest.mark.parametrize(
    ("gap", "width"), [(600, 600), (420, 400), (86_400, 86_400), (200_000, 86_400), (86_399, 43_200)]
)
def test_slices_divide_the_day(gap, width):
    assert day_divisor(gap * 1_000_000) == width * 1_000_000
    assert day_divisor(0) == 1 and day_divisor(7) == 6


def random_keys(seed, count=500):
    """Key events where one app has a third of the rows, with copies, threshold gaps and several days."""
    rng = random.Random(seed)
    t, rows = DAY - timedelta(days=2), []
    for _ in range(count):
        t += timedelta(seconds=rng.choice([0, 0, 1, 60, 179, 180, 181, 599, 600, 601, 4000]), microseconds=rng.choice([0, 0, 1]))
        rows.append((t, "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_the_event_by_event_form(keys, seed):
    kev = keys(random_keys(seed)).cache()
    times = ["session_date", "session_number", "session_start", "session_end"]
    same_rows(active_sessions_by_app(kev), naive.sessions(kev, "10 minutes", True), ["App", *times])
    for gap in ("3 minutes", "7 minutes", "1 second", "2 days"):
        found = active_sessions(kev, AS_OF, gap, "1 year")
        same_rows(found, naive.sessions(kev, gap, False), times)


def test_sessions_equal_session_windows(keys):
    kev = keys(random_keys(7))
    found = daily_sessions(kev, ["App"], "Timestamp", fixed_micros("10 minutes"), numbered=False).select(
        "App", from_micros(F.col("lo")).alias("a"), from_micros(F.col("hi")).alias("b")
    )
    expected = kev.groupBy("App", F.to_date("Timestamp"), F.session_window("Timestamp", "10 minutes")).agg(
        F.min("Timestamp").alias("a"), F.max("Timestamp").alias("b")
    )
    same_rows(found, expected, ["App", "a", "b"])


def minutes_ago(*minutes, **more):
    return [{"t": AS_OF - timedelta(minutes=m), **more} for m in minutes]


def test_session_is_reported_by_the_break_after_it(events):
    row = session_times(events(minutes_ago(60, 50, 49, 47, 30)), AS_OF).collect()
    # Breaks at -50 and -30: the first has no start, the second reports -50 to -47.
    assert len(row) == 1
    assert (row[0].total_minutes, row[0].number_of_sessions, row[0].median_session_duration) == (3.0, 2, 3.0)
    assert row[0].total_time == timedelta(minutes=3)
    assert row[0].sessions_end == AS_OF - timedelta(minutes=47)
    assert row[0].day_of_week == "sunday"


def test_only_a_running_session(events):
    rows = session_times(events(minutes_ago(*[1 + k / 600 for k in range(11)])), AS_OF).collect()
    assert [(r.total_hours, r.number_of_sessions) for r in rows] == [(0.0, 1)]


def test_no_break_and_nothing_open_reports_nothing(events):
    assert session_times(events(minutes_ago(20, 19, 18)), AS_OF).collect() == []


def test_open_session_omits_its_last_key(events):
    rows = session_times(events(minutes_ago(20, 10, 8, 6, 4, 2)), AS_OF).collect()
    assert (rows[0].total_minutes, rows[0].number_of_sessions) == (6.0, 2)


def test_threshold_is_strict_on_both_sides(events):
    assert session_times(events(minutes_ago(9, 6, 3)), AS_OF).collect() == []


def test_padded_weekday(events):
    row = session_times(events(minutes_ago(1)), AS_OF, padded=True).first()
    assert row.day_of_week == "sunday   " and row.sessions_end is None


@pytest.mark.parametrize("seed", range(4))
def test_session_times_equal_the_event_by_event_form(events, seed):
    rng = random.Random(seed)
    t, rows = AS_OF - timedelta(days=3), []
    while t < AS_OF + timedelta(minutes=seed):
        t += timedelta(seconds=rng.choice([0, 0, 20, 179, 180, 181, 3000]), microseconds=rng.choice([0, 1]))
        rows.append({"t": t, "user": "hot" if rng.random() < 0.34 else rng.choice("abc")})
    rows += [{"t": rows[-1]["t"], "user": u} for u in ("hot", "hot", "a")]
    ev = events(rows).cache()
    columns = ["user_id", "session_date", "total_minutes", "number_of_sessions", "median_session_duration", "sessions_end"]
    for now in (AS_OF, AS_OF - timedelta(hours=7), AS_OF + timedelta(minutes=1)):
        same_rows(session_times(ev, now), naive.session_times(ev, now), columns)


def test_one_user_of_session_times(events):
    ev = events(minutes_ago(60, 50, 30) + minutes_ago(60, 10, user="bob"))
    assert [r.user_id for r in session_times(ev, AS_OF, user="bob").collect()] == ["bob"]

import random
from datetime import datetime, timedelta

import pytest

from tests import naive
from tests.conftest import AS_OF
from tests.rows import same_rows
from typeflow.operators.flows import speed_by_time_of_day, typing_speed

NOW = AS_OF + timedelta(milliseconds=1)


def ago(**delta):
    return AS_OF - timedelta(**delta)


def speeds(ev, **options):
    return typing_speed(ev, options.pop("as_of", NOW), **options).collect()


def test_flows_weigh_by_their_events(events):
    ev = events(
        [{"t": ago(milliseconds=k * 3)} for k in range(10)]
        + [{"t": ago(milliseconds=k * 8 + 55), "url": "google.com"} for k in range(30)]
    )
    rows = speeds(ev)
    assert len(rows) == 24
    assert rows[0].speed == 0.25 * 3 + 0.75 * 8
    assert rows[0].event_count == 40 and rows[0].volatility == pytest.approx(12.5**0.5)


def test_no_flow_gives_no_rows(events):
    old = events([{"t": datetime(2000, 1, 1)}])
    assert speeds(old) == []
    assert speeds(old.limit(0)) == []


def test_sites_are_kept_apart(events):
    ev = events(
        [{"t": ago(milliseconds=k)} for k in (0, 5, 10)]
        + [{"t": ago(milliseconds=k), "url": "google.com"} for k in (50, 55, 60)]
    )
    rows = speeds(ev)
    assert len(rows) == 24 and rows[0].speed == 5
    assert all(row.speed is None and row.event_count == 0 and row.relative_error == 0 for row in rows[1:])


def test_lone_event_before_a_pause_is_ignored(events):
    rows = speeds(events([{"t": ago(milliseconds=k)} for k in (0, 5, 10, 15, 20)] + [{"t": ago(seconds=30)}]))
    assert len(rows) == 24 and rows[0].speed == 5 and rows[0].event_count == 5


def test_events_of_their_own_session_form_no_flow(events):
    ev = events([{"t": ago(milliseconds=k), "session": str(k)} for k in range(11)])
    assert speeds(ev) == []


def test_gap_of_exactly_the_pause_does_not_break(events):
    rows = speeds(events([{"t": ago(seconds=s)} for s in (0, 5, 10)]))
    assert rows[0].event_count == 3 and rows[0].speed == 5000 and rows[0].volatility == 0


def test_pause_counts_for_the_flow_it_ends(events):
    ev = events([{"t": ago(milliseconds=k)} for k in (0, 4, 30_000, 30_010)])
    rows = speeds(ev)
    first, second = (10 + 29_996) / 2, 4
    assert rows[0].speed == pytest.approx((first * 2 + second * 2) / 4)


def test_pause_over_a_minute_keeps_the_seconds_field(events):
    ev = events([{"t": ago(milliseconds=k)} for k in (0, 4, 65_104, 65_114)])
    assert speeds(ev)[0].speed == pytest.approx(((10 + 5100) / 2 + 4) / 2)
    assert speeds(ev, ms="elapsed")[0].speed == pytest.approx(((10 + 65_100) / 2 + 4) / 2)


def test_long_allowed_pause_still_wraps_inside_a_flow(events):
    ev = events([{"t": ago(seconds=s)} for s in (0, 70, 200)])
    rows = speeds(ev, flow_gap="5 minutes")
    assert rows[0].speed == pytest.approx((10_000 + 10_000) / 2) and rows[0].event_count == 3


def test_null_url_is_a_site_of_its_own(events):
    ev = events([{"t": ago(milliseconds=k), "url": None} for k in (0, 6)] + [{"t": ago(milliseconds=3)}])
    rows = speeds(ev)
    assert rows[0].speed == 6 and rows[0].event_count == 2


def test_tied_times_count_zero(events):
    rows = speeds(events([{"t": ago(milliseconds=k)} for k in (0, 0, 0, 9)]))
    assert rows[0].speed == 3 and rows[0].event_count == 4


def test_errors_ignore_null_flags(events):
    ev = events([{"t": ago(milliseconds=k), "error": e} for k, e in ((0, True), (1, None), (2, False), (3, True))])
    rows = speeds(ev)
    assert (rows[0].error_count, rows[0].relative_error) == (2, 0.5)


def test_lookback_is_inclusive_and_future_windows_reach_over_now(events):
    ev = events([{"t": NOW - timedelta(hours=6)}, {"t": NOW - timedelta(hours=6) + timedelta(milliseconds=7)}])
    assert speeds(ev)[-1].speed == 7
    future = events([{"t": NOW + timedelta(milliseconds=k)} for k in (1, 3)])
    rows = typing_speed(future, NOW, lookback="20 minutes").collect()
    assert [row.event_count for row in rows] == [2, 0]


def test_user_with_flows_only_at_now_gets_empty_windows(events):
    rows = speeds(events([{"t": NOW + timedelta(milliseconds=k)} for k in (1, 3)]))
    assert len(rows) == 24 and {row.event_count for row in rows} == {0}


def test_one_user(events):
    ev = events([{"t": ago(milliseconds=k), "user": u} for u, k in (("a", 0), ("a", 2), ("b", 0), ("b", 9))])
    assert {row.user_id for row in speeds(ev)} == {"a", "b"}
    assert {(row.user_id, row.speed) for row in speeds(ev, user="b")} == {("b", 9.0), ("b", None)}


def test_month_steps_stay_clamped(events):
    now = datetime(2024, 4, 30)
    ev = events([{"t": datetime(2024, 3, 30, 0, 0, 0, k)} for k in (0, 2000)])
    rows = typing_speed(ev, now, lookback="3 months", resolution="1 month", newest_first=False).collect()
    starts = [datetime(2024, 1, 30), datetime(2024, 2, 29), datetime(2024, 3, 29), datetime(2024, 4, 29)]
    assert [row.window_start for row in rows] == starts
    assert [row.event_count for row in rows] == [0, 0, 2, 0]


def random_events(seed, count=400, spread=2_000_000, tie=0.2):
    """Events of few users, one of whom has a third of them, with ties and pauses around the thresholds."""
    rng = random.Random(seed)
    t, rows = AS_OF - timedelta(hours=1), []
    for _ in range(count):
        step = rng.choice([0, 1, spread, 4_999_999, 5_000_000, 5_000_001, 30_000_000, 61_500_000])
        t += timedelta(microseconds=0 if rng.random() < tie else rng.choice([step, rng.randrange(spread)]))
        rows.append(
            {
                "t": t,
                "user": "hot" if rng.random() < 0.34 else rng.choice("abc"),
                "session": rng.choice("12"),
                "url": rng.choice(["x.com", "y.com", None]),
                "error": rng.choice([True, False, None]),
            }
        )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_typing_speed_equals_the_event_by_event_form(events, seed):
    ev = events(random_events(seed, spread=200_000)).cache()
    columns = "user_id window_start speed volatility event_count error_count relative_error".split()
    for resolution, gap in (("15 minutes", "5 seconds"), ("7 minutes", "90 seconds")):
        found = typing_speed(ev, AS_OF, lookback="1 hour", resolution=resolution, flow_gap=gap)
        same_rows(found, naive.typing_speed(ev, AS_OF, "1 hour", resolution, gap), columns)


@pytest.mark.parametrize("seed", range(3))
def test_speed_by_time_of_day_equals_the_event_by_event_form(events, seed):
    ev = events(random_events(seed, tie=0.4, spread=1_500_000)).cache()
    found = speed_by_time_of_day(ev, AS_OF, min_events=1)
    expected = naive.speed_by_time_of_day(ev, AS_OF, min_events=1)
    assert expected
    same_rows(found, expected, ["time_bin", "speed", "volatility", "event_count"])


def test_speed_by_time_of_day_minimum_and_label(events):
    base = datetime(2024, 3, 10, 9, 3)
    ev = events([{"t": base + timedelta(seconds=k)} for k in range(8)])
    row = speed_by_time_of_day(ev, AS_OF).first()
    assert (row.time_bin, row.speed, row.event_count) == ("9:0", 1000.0, 7)
    assert speed_by_time_of_day(ev, AS_OF, min_events=7).count() == 0
    assert speed_by_time_of_day(ev, AS_OF, padded=True).first().time_bin == "09:00"

from datetime import timedelta

import pytest

from tests.conftest import AS_OF
from typeflow.functions.text import duration_text
from typeflow.plans.reports import (
    insights,
    week_over_week,
    week_over_week_pivot,
    weekly_report,
    weekly_report_rows,
    write_weekly_report,
)
from typeflow.plans.views import create_views
from typeflow.session import new_folder
from pyspark.sql import functions as F


def days_ago(*days, **more):
    return [{"t": AS_OF - timedelta(days=d), **more} for d in days]


def test_week_bounds(events):
    ev = events(days_ago(0, 6.9, 7, 7.1, 14, 14.1))
    counts = {}
    for row in week_over_week(ev, AS_OF).collect():
        counts[row.horizon] = counts.get(row.horizon, 0) + row.event_count
    assert counts == {"Current": 2, "Previous": 3}


def test_week_over_week_rows(events):
    ev = events(days_ago(1, 1.01, 8, 2) + days_ago(1, user="bob"))
    rows = [(r.horizon, r.day_of_week, r.event_count) for r in week_over_week(ev, AS_OF, "alice").collect()]
    assert rows == [("Current", "Friday", 1), ("Current", "Saturday", 2), ("Previous", "Saturday", 1)]
    assert week_over_week(ev, AS_OF, "alice").collect()[1].start_date == AS_OF - timedelta(days=1.01)
    pivot = [tuple(r) for r in week_over_week_pivot(ev, AS_OF, "alice").collect()]
    assert pivot == [("Friday", 1, None), ("Saturday", 2, 1)]


def test_weekly_report_is_written(spark, events):
    ev = events(days_ago(1, 8, url="https://a.com/x"))
    tables = weekly_report(ev, AS_OF)
    assert set(tables) == {"week_over_week", "top_sites", "time_of_day"}
    folder = new_folder(spark, "report")
    write_weekly_report(ev, folder, AS_OF, fmt="json")
    assert spark.read.json(f"{folder}/top_sites").first().url == "a.com"
    rows = {(r.section, r.series, r.label): r.value for r in weekly_report_rows(ev, AS_OF).collect()}
    assert rows == {
        ("week_over_week", "Current", "Saturday"): 1.0,
        ("week_over_week", "Previous", "Saturday"): 1.0,
        ("top_sites", None, "a.com"): 1.0,
        ("time_of_day", None, "12:00"): 1.0,
    }


def test_insights(events):
    ev = events([{"t": AS_OF - timedelta(milliseconds=k)} for k in (1, 4, 7)])
    tables = insights(ev, AS_OF, "1 day")
    series = tables["typing"].collect()
    assert len(series) == 96 and series[-1].speed == 3 and series[-1].event_count == 3
    assert series[0].window_start == AS_OF - timedelta(days=1)
    assert tables["top_sites"].first().event_count == 3
    for period, windows in (("5 days", 480), ("90 minutes", 6)):
        assert insights(ev, AS_OF, period)["typing"].count() == windows


def test_views(spark, keys):
    create_views(keys([(AS_OF - timedelta(minutes=m), "Editor") for m in (5, 4, 3)]), AS_OF)
    row = spark.sql("select App, sum(duration) as total_time from active_sessions_by_app group by App").first()
    assert (row.App, row.total_time) == ("Editor", 120.0)
    assert spark.sql("select * from active_sessions").count() == 1
    assert spark.sql("select max(Timestamp) as t from key_events").first().t == AS_OF - timedelta(minutes=3)


@pytest.mark.parametrize(
    ("seconds", "text"),
    [(0.0, ""), (59.9, "59s"), (60.0, "1min"), (3600.0, "1h"), (3723.4, "1h 2min 3s"), (360000.0, "100h")],
)
def test_duration_text(spark, seconds, text):
    assert spark.range(1).select(duration_text(F.lit(seconds))).first()[0] == text

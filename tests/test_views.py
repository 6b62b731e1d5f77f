"""The stored views, and folders for intermediate tables."""

from datetime import datetime, timedelta, timezone

import pytest

from typeflow import session
from typeflow.functions.time import Span, span
from typeflow.plans.views import create_views


def test_the_view_of_recent_sessions_moves_with_time(spark, keys):
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    old, new = now - timedelta(hours=30), now - timedelta(hours=2)
    create_views(keys([(t + timedelta(seconds=s), "a") for t in (old, new) for s in (0, 5)]))
    assert [r.session_start for r in spark.sql("select session_start from active_sessions").collect()] == [new]
    plan = spark.table("active_sessions")._jdf.queryExecution().analyzed().toString().lower()
    assert "localtimestamp" in plan  # no instant is fixed in it


def test_a_view_of_a_given_instant_stays(spark, keys):
    t = datetime(2024, 1, 1, 12)
    create_views(keys([(t, "a"), (t + timedelta(seconds=9), "a")]), t + timedelta(hours=1))
    assert spark.sql("select * from active_sessions").count() == 1


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf(conf)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(**{"spark.master": "spark://host:7077"}))
    named = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.shared_folder(named) == "hdfs:///shared"
    assert session.shared_folder(Session(**{"spark.master": "local[2]"}))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("90 min", Span(0, 5_400_000_000)),
        ("2 hrs", Span(0, 7_200_000_000)),
        ("01:30:00", Span(0, 5_400_000_000)),
        ("1 mon", Span(1, 0)),
        ("P1D", Span(0, 86_400_000_000)),
        ("P1MT2H", Span(1, 7_200_000_000)),
    ],
)
def test_short_interval_texts(text, expected):
    assert span(text) == expected

import pytest

from tests.conftest import AS_OF
from typeflow.functions.text import host
from typeflow.operators.counters import event_count, event_count_by_user, now_stats, recent_events, status
from typeflow.operators.sites import host_sample, site_counts, site_reach, site_users, top_sites
from datetime import timedelta


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a:b@c.com/x", "c.com"),
        ("http://www.example.com:8080/path?q=1", "www.example.com"),
        ("localhost:3000", "localhost"),
        ("a@b@c", "b@c"),
        ("http://", "http"),
        ("HTTPS://X.com", "HTTPS"),
        ("example.com?q=1", "example.com?q=1"),
        ("/x", None),
        ("", None),
        (None, None),
    ],
)
def test_host(spark, url, expected):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(host("url").alias("h")).first().h == expected


def test_no_events_no_sites(events):
    assert top_sites(events([{"t": AS_OF}]).limit(0), AS_OF).collect() == []


def test_ranking(events):
    ev = events([{"t": AS_OF, "url": u} for u in ["google.com"] * 3 + ["facebook.com"] + ["/none", None]])
    assert [(r.url, r.event_count) for r in top_sites(ev, AS_OF).collect()] == [("google.com", 3), ("facebook.com", 1)]
    assert top_sites(ev, AS_OF, n=1).count() == 1
    assert site_counts(ev).count() == 2


def test_reach_and_users(events):
    urls = [("a", "mail.Google.com"), ("b", "https://mail.Google.com/x"), ("b", "mail.Google.com"), ("a", "other.com")]
    ev = events([{"t": AS_OF, "user": u, "url": url} for u, url in urls])
    row = site_reach(ev, "%google%").collect()
    assert [(r.url, r.event_count, r.user_count) for r in row] == [("mail.Google.com", 3, 2)]
    assert site_reach(ev, approximate=True).first().user_count == 2
    assert {(r.user_id, r.event_count) for r in site_users(ev, "%GOOGLE%").collect()} == {("a", 1), ("b", 2)}


def test_sample_limits_before_extraction(events):
    ev = events([{"t": AS_OF, "url": u} for u in ["/none", "a.com", "b.com"]])
    assert [r.url for r in host_sample(ev, 2).collect()] == ["a.com"]


def test_now_stats_treats_null_as_false(events):
    flags = [(None, True, None), (True, None, True), (False, None, False), (True, True, None)]
    ev = events([{"t": AS_OF, "word": w, "line": li, "error": e} for w, li, e in flags] + [{"t": AS_OF - timedelta(hours=1)}])
    row = now_stats(ev, AS_OF).first()
    assert (row.total_count, row.error_count, row.word_count) == (4, 1, 3)
    empty = now_stats(ev.limit(0), AS_OF).first()
    assert (empty.total_count, empty.error_count, empty.word_count) == (0, 0, 0)


def test_recent_events_are_the_newest(events):
    ev = events([{"t": AS_OF - timedelta(minutes=m)} for m in (50, 10, 30, 70)])
    assert [r.keystroke_id for r in recent_events(ev, AS_OF, n=2).collect()] == [1, 2]
    assert recent_events(ev, lookback=None).count() == 4


def test_counts(events, keys):
    ev = events([{"t": AS_OF, "user": "jean"}])
    assert event_count_by_user(ev, "jean").first().event_count == 1
    assert event_count_by_user(ev, "nobody").first().event_count == 0
    assert event_count_by_user(ev).first().event_count == 1
    kev = keys([(AS_OF, "a"), (AS_OF - timedelta(days=1), "b")])
    assert tuple(status(kev).first()) == (AS_OF, 2) and event_count(kev).first().event_count == 2

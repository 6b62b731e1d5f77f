"""The registered queries: every operator over the given tables, with fixed reference instants.

Doubles are rounded to six places, and intervals given as seconds, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeflow.functions.keys import key_category
from typeflow.functions.time import micros
from typeflow.operators.counters import event_count, event_count_by_user, now_stats, recent_events, status
from typeflow.operators.evolution import add_tags
from typeflow.operators.flows import speed_by_time_of_day, typing_speed
from typeflow.operators.intervals import inter_key_interval
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
from typeflow.operators.session_days import SessionDays
from typeflow.operators.sites import host_sample, site_counts, site_reach, site_users, top_sites
from typeflow.plans.reports import insights, week_over_week, week_over_week_pivot, weekly_report_rows
from typeflow.plans.views import create_views
from typeflow.session import new_folder
from typeflow.sources.events import append_events, ingest_batches, numbered_events, read_events
from typeflow.sources.key_csv import key_preview, read_key_csv, write_key_csv
from typeflow.sources.tables import (
    AS_OF,
    FAST_AS_OF,
    key_events,
    key_events_with_gaps,
    raw_keys,
    raw_requests,
    table,
    typing_events,
    typing_events_fast,
)
from typeflow.streaming import jobs, open_sessions

Query = Callable[[SparkSession, str], DataFrame]

USER = "u3"
PATTERN = "%blog%"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(name, 6).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes]
    )


def on_typing(operator: Callable[..., DataFrame], *args, **options) -> Query:
    """A query that applies an operator to the typing events."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(operator(typing_events(spark, sf_dir), *args, **options))

    return query


def on_fast_typing(operator: Callable[..., DataFrame], *args, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(operator(typing_events_fast(spark, sf_dir), *args, **options))

    return query


def on_keys(operator: Callable[..., DataFrame], *args, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(operator(key_events(spark, sf_dir), *args, **options))

    return query


def _session_times(ev: DataFrame, **options) -> DataFrame:
    """Session times with the interval of the total as seconds, NULL where it is."""
    units = (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))
    total = sum(F.extract(F.lit(unit), F.col("total_time")).cast("double") * n for unit, n in units)
    return session_times(ev, AS_OF, **options).withColumn("total_time", total)


def _time_grid(ev: DataFrame) -> DataFrame:
    ends = ev.groupBy("user_id").agg(F.max("record_time").alias("ts"))
    return time_grid(ends, "ts", "15 minutes", 12).select("user_id", "time_of_day")


def _time_grid_months(ev: DataFrame) -> DataFrame:
    ends = ev.groupBy("user_id").agg(F.max("record_time").alias("ts"))
    ends = ends.withColumn("ts", F.date_trunc("month", "ts").cast("timestamp_ntz") + F.expr("interval 30 days"))
    return time_grid(ends, "ts", "1 month", 4).select("user_id", "time_of_day")


def _view(name: str) -> Query:
    """A stored view, read through SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        create_views(key_events(spark, sf_dir), AS_OF)
        return rounded(spark.sql(f"select * from {name}"))

    return query


def _kept_sessions(keys: Sequence[str], gap: str, lookback: str) -> Query:
    """Recent sessions, numbered from a table of session days that was kept in two steps."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kev = key_events(spark, sf_dir)
        days = SessionDays(new_folder(spark, "session-days"), keys, gap)
        days.update(kev, AS_OF - timedelta(days=12))
        days.update(kev, AS_OF)
        return rounded(days.recent(kev, AS_OF, lookback))

    return query


def _intervals(kev: DataFrame, keys) -> DataFrame:
    return inter_key_interval(kev, keys).select("event_id", "App", "interval_us")


def _tagged(ev: DataFrame) -> DataFrame:
    return add_tags(ev).select("keystroke_id", "source_url", F.array_join("tags", ",").alias("tags"))


def _insights_typing(ev: DataFrame) -> DataFrame:
    return insights(ev, FAST_AS_OF, "12 hours")["typing"]


def _insights_sites_five_days(ev: DataFrame) -> DataFrame:
    return insights(ev, AS_OF, "5 days 6 hours")["top_sites"]


def _insights_sites(ev: DataFrame) -> DataFrame:
    return insights(ev, AS_OF, "1 week")["top_sites"]


def _key_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_keys(spark, sf_dir).select(
        "event_id", "kind", "keycode", key_category(F.col("kind"), F.col("keycode")).alias("category")
    )


def _fixed_ids() -> dict:
    """Ingestion time and batch ids that are the same in every run."""
    return {
        "ingestion_time": F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"),
        "batch_id": F.md5(F.concat_ws("-", "user_id", "session_id", micros("record_time"))),
    }


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_events(ingest_batches(raw_requests(spark, sf_dir), **_fixed_ids()))


def _ingested_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_events(ingest_batches(raw_requests(spark, sf_dir, zoned=True), **_fixed_ids()))


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to the date-partitioned table and read back for one period."""
    path = new_folder(spark, "events")
    append_events(typing_events(spark, sf_dir), path)
    return top_sites(read_events(spark, path), AS_OF, "2 weeks")


def _csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "key-csv")
    write_key_csv(key_events(spark, sf_dir), path, 10_000)
    return read_key_csv(spark, path)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kev = _csv_table(spark, sf_dir)
    return kev.select("Timestamp", F.col("Interval_ns").cast("long").alias("Interval_ns"), "SeqNum", "App", "Title", "Category")


def _csv_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "key-csv-gaps")
    write_key_csv(key_events_with_gaps(spark, sf_dir), path, 10_000, zone="Europe/Paris", compressed=True)
    kev = read_key_csv(spark, path, zone="Europe/Paris")
    return kev.select(
        "Timestamp", F.col("Interval_ns").cast("long").alias("Interval_ns"), "SeqNum", "App", "Title", "Category"
    )


def _csv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview takes any ten rows, so only its size and the constant column are fixed."""
    return key_preview(_csv_table(spark, sf_dir)).groupBy("SeqNum").agg(F.count("App").alias("row_count"))


def _s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path, checkpoint = (new_folder(spark, name) for name in ("requests", "ingested", "ingest-state"))
    raw_requests(spark, sf_dir).write.json(source)
    jobs.ingest_stream(spark, source, path, checkpoint, **_fixed_ids()).awaitTermination()
    return read_events(spark, path).drop("tags", "event_date")


def _stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return jobs.read_parquet_stream(spark, sf_dir, schema, "events.parquet")


def _s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = new_folder(spark, "counts"), new_folder(spark, "counts-state")
    ev = _stream_of(spark, sf_dir).select(
        F.col("ts").alias("record_time"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user_id"),
        (F.col("event_type") == "error").alias("is_return"),
    )
    live = jobs.live_counts(ev)
    jobs.start_counts(live, path, checkpoint).awaitTermination()
    return jobs.latest_counts(spark, path, live.schema)


def _s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = new_folder(spark, "sessions"), new_folder(spark, "sessions-state")
    kev = _stream_of(spark, sf_dir).select(F.col("event_type").alias("App"), F.col("ts").alias("Timestamp"))
    open_sessions.start_session_changes(open_sessions.live_session_changes(kev), path, checkpoint).awaitTermination()
    return open_sessions.latest_sessions(spark, path)


def _s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = new_folder(spark, "status"), new_folder(spark, "status-state")
    live = jobs.live_status(_stream_of(spark, sf_dir).select(F.col("ts").alias("Timestamp")))
    jobs.start_status(live, path, checkpoint).awaitTermination()
    return jobs.latest_status(spark, path, live.schema)


def queries() -> dict[str, Query]:
    return {
        "q01_typing_speed": on_fast_typing(typing_speed, FAST_AS_OF),
        "q01_typing_speed_one_user": on_fast_typing(typing_speed, FAST_AS_OF, user=USER),
        "q01_typing_speed_elapsed": on_fast_typing(typing_speed, FAST_AS_OF, ms="elapsed"),
        "q01_typing_speed_monthly": on_typing(
            typing_speed, AS_OF, lookback="3 months", resolution="1 month", flow_gap="3 days"
        ),
        "q02_session_times": on_typing(_session_times),
        "q02_session_times_one_user": on_typing(_session_times, user=USER),
        "q03_top_sites": on_typing(top_sites, AS_OF, name="count"),
        "q03_top_sites_one_user": on_typing(top_sites, AS_OF, name="count", user=USER),
        "q04_top_sites_week": on_typing(top_sites, AS_OF, "1 week"),
        "q05_site_counts": on_typing(site_counts),
        "q06_site_reach": on_typing(site_reach, PATTERN),
        "q07_site_users": on_typing(site_users, PATTERN),
        "q08_host_sample": on_typing(host_sample),
        "q09_day_of_week": on_typing(day_of_week, AS_OF),
        "q09_day_of_week_one_user": on_typing(day_of_week, AS_OF, user=USER),
        "q10_day_of_week_all": on_typing(day_of_week, lookback=None),
        "q11_time_of_day": on_typing(time_of_day, AS_OF),
        "q11_time_of_day_one_user": on_typing(time_of_day, AS_OF, user=USER),
        "q12_time_of_day_quarter_hours": on_typing(time_of_day, AS_OF, "1 hour", "15 minutes"),
        "q13_time_of_day_labelled": on_typing(time_of_day_labelled, AS_OF),
        "q14_time_of_day_all": on_typing(time_of_day, lookback=None, width="15 minutes"),
        "q15_time_of_day_total": on_typing(time_of_day_total),
        "q16_time_of_day_total_dense": on_typing(time_of_day_total_dense),
        "q17_time_of_day_dense": on_typing(time_of_day_dense),
        "q17_time_of_day_dense_full": on_typing(time_of_day_dense, full_last_day=True),
        "q18_activity_range": on_typing(activity_range),
        "q19_time_grid": on_typing(_time_grid),
        "q19_time_grid_months": on_typing(_time_grid_months),
        "q20_speed_by_time_of_day": on_fast_typing(speed_by_time_of_day, FAST_AS_OF),
        "q20_speed_by_time_of_day_by_user": on_fast_typing(speed_by_time_of_day, FAST_AS_OF, by_user=True),
        "q21_now_stats": on_typing(now_stats, AS_OF),
        "q22_recent_events": on_typing(recent_events, AS_OF),
        "q22_recent_events_one_user": on_typing(recent_events, AS_OF, "1 day", user=USER),
        "q22_recent_events_all": on_typing(recent_events, lookback=None),
        "q23_active_sessions_by_app": on_keys(active_sessions_by_app),
        "q23_view": _view("active_sessions_by_app"),
        "q24_view": _view("active_sessions"),
        "q24_active_sessions": on_keys(active_sessions, AS_OF),
        "q24_active_sessions_history": on_keys(active_sessions, AS_OF, lookback="1 year"),
        "q24_active_sessions_kept": _kept_sessions((), "3 minutes", "24 hours"),
        "q25_active_time_by_app": on_keys(active_time_by_app),
        "q26_recent_sessions_by_app": on_keys(recent_sessions_by_app, AS_OF, as_text=True),
        "q26_recent_sessions_in_full": on_keys(recent_sessions_in_full, AS_OF),
        "q26_recent_sessions_kept": _kept_sessions(("App",), "10 minutes", "3 hours"),
        "q27_total_active_time": on_keys(total_active_time, AS_OF),
        "q28_session_apps": on_keys(session_apps),
        "q28_session_extent": on_keys(session_extent),
        "q28_session_apps_recent": on_keys(session_apps, as_of=AS_OF, lookback="24 hours"),
        "q28_session_extent_recent": on_keys(session_extent, as_of=AS_OF, lookback="24 hours"),
        "q29_status": on_keys(status),
        "q30_event_count": on_keys(event_count),
        "q31_event_count_one_user": on_typing(event_count_by_user, USER),
        "q31_event_count_by_user": on_typing(event_count_by_user),
        "q32_week_over_week": on_typing(week_over_week, AS_OF),
        "q32_week_over_week_one_user": on_typing(week_over_week, AS_OF, user=USER),
        "q33_week_over_week_pivot": on_typing(week_over_week_pivot, AS_OF),
        "q34_weekly_report": on_typing(weekly_report_rows, AS_OF),
        "q35_ingest_batches": _ingested,
        "q35_ingest_zoned": _ingested_zoned,
        "q35_append_events": _appended,
        "q36_key_category": _key_categories,
        "q37_inter_key_interval": on_keys(_intervals, []),
        "q37_inter_key_interval_by_app": on_keys(_intervals, ["App"]),
        "q38_key_csv_round_trip": _csv_round_trip,
        "q38_key_csv_gaps": _csv_gaps,
        "q38_key_csv_preview": _csv_preview,
        "q39_add_tags": on_typing(_tagged),
        "q40_insights_top_sites": on_typing(_insights_sites),
        "q40_insights_any_period": on_typing(_insights_sites_five_days),
        "q40_insights_typing": on_fast_typing(_insights_typing),
        "s01_ingest_stream": _s01,
        "s02_live_counts": _s02,
        "s03_live_sessions": _s03,
        "s04_live_status": _s04,
    }

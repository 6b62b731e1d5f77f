import json
from datetime import timedelta

from pyspark.sql import functions as F

from tests.conftest import AS_OF
from tests.rows import same_rows
from typeflow.session import new_folder
from typeflow.sources.events import read_events
from typeflow.operators.sessions import active_sessions_by_app
from typeflow.streaming import jobs, open_sessions, upserts


def stream(spark, df, name, files=1):
    """The rows of ``df`` as a stream over parquet files, one file per micro-batch in the order of the first column."""
    folder = new_folder(spark, name)
    rows = df.orderBy("i").collect()
    size = -(-len(rows) // files)
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start : start + size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, live, start):
    path, checkpoint = new_folder(spark, "out"), new_folder(spark, "state")
    start(live, path, checkpoint).awaitTermination()
    return spark.read.schema(live.schema).parquet(path)


def test_ingestion_takes_each_file_once(spark, tmp_path):
    source, path, checkpoint = str(tmp_path), new_folder(spark, "table"), new_folder(spark, "state")
    event = {"record_time": "2024-03-10 11:00:00", "session_id": "s", "source_url": "a.com",
             "is_end_of_word": True, "is_end_of_line": False, "is_return": False}

    def post(name, count):
        request = {"user_id": "u", "host": "h", "user_agent": "a", "accept_language": "en",
                   "body": json.dumps({"events": [event] * count})}
        (tmp_path / name).write_text(json.dumps(request) + "\n")

    for name, count, total in (("1.json", 2, 2), ("2.json", 3, 5)):
        post(name, count)
        jobs.ingest_stream(spark, source, path, checkpoint).awaitTermination()
        assert read_events(spark, path).count() == total
    row = read_events(spark, path).first()
    assert row.agent_description == "h#a#en" and str(row.event_date) == "2024-03-10"


def test_live_counts_wait_for_the_watermark_and_drop_late_events(spark):
    minutes = [0, 1, 14, 16, 40, 41, 2, 61]
    rows = [(i, AS_OF + timedelta(minutes=m), "u", i == 1) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "i int, record_time timestamp_ntz, user_id string, is_return boolean")
    found = run(spark, jobs.live_counts(stream(spark, df, "counts", 8)), jobs.start_append)
    got = {(r.window_start - AS_OF).seconds // 60: (r.event_count, r.error_count) for r in found.collect()}
    # Minute 2 arrives a batch after the watermark (40 - 10) has passed its window; the last window is still open.
    assert got == {0: (3, 1), 15: (1, 0), 30: (2, 0)}


def test_live_sessions_match_the_batch_form(spark):
    minutes = [0, 4, 14, 25, 26, 60, 61, 200]
    rows = [(i, AS_OF + timedelta(minutes=m), "hot" if i % 3 else None) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "i int, Timestamp timestamp_ntz, App string")
    found = run(spark, jobs.live_sessions(stream(spark, df, "keys", 4)), jobs.start_sessions)
    expected = (
        df.groupBy("App", F.to_date("Timestamp").alias("session_date"), F.session_window("Timestamp", "10 minutes"))
        .agg(F.min("Timestamp").alias("session_start"), F.max("Timestamp").alias("session_end"))
        .filter("session_end > session_start")
    )
    assert expected.count() > 0
    same_rows(found, expected, ["App", "session_date", "session_start", "session_end"])


def test_live_counts_show_open_windows_as_they_grow(spark):
    minutes = [0, 1, 14, 16, 40, 41, 2, 61, 62]
    rows = [(i, AS_OF + timedelta(minutes=m), "u", i == 1) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "i int, record_time timestamp_ntz, user_id string, is_return boolean")
    live = jobs.live_counts(stream(spark, df, "counts", 9))
    path, checkpoint = new_folder(spark, "out"), new_folder(spark, "state")
    jobs.start_counts(live, path, checkpoint).awaitTermination()
    found = jobs.latest_counts(spark, path, live.schema).collect()
    got = {(r.window_start - AS_OF).seconds // 60: (r.event_count, r.error_count) for r in found}
    # Minute 2 comes after the watermark has passed its window; the last window is there though it is still open.
    assert got == {0: (3, 1), 15: (1, 0), 30: (2, 0), 60: (2, 0)}


def test_upserts_count_a_repeated_batch_once_and_bound_their_folders(spark, monkeypatch):
    monkeypatch.setattr(upserts, "EVERY", 3)
    path, schema = new_folder(spark, "upserts"), "k string, v bigint"
    expected, most = {}, 0
    for number in range(40):
        rows = [(None if number % 5 == 0 else f"k{number % 7}", number), ("all", number)]
        expected |= dict(rows)
        for _ in range(2 if number % 4 == 2 else 1):
            upserts.put(spark.createDataFrame(rows, schema), number, path, ["k"])
        most = max(most, len(upserts.runs(spark, path)))
        if number in (2, 8, 25, 39):
            found = upserts.latest(spark, path, spark.createDataFrame([], schema).schema, ["k"])
            assert {r.k: r.v for r in found.collect()} == expected
    assert most <= 20


def test_a_batch_that_is_not_complete_does_not_count(spark):
    path, frame = new_folder(spark, "upserts"), spark.createDataFrame([("k", 1)], "k string, v bigint")
    upserts.put(frame, 0, path, ["k"])
    frame.withColumn("_batch", F.lit(5)).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{path}/run-000000000005-000000000005")
    assert upserts.runs(spark, path) == [(0, 0)]
    assert upserts.latest(spark, path, frame.schema, ["k"]).count() == 1


def run_sessions(spark, df, files):
    path, checkpoint = new_folder(spark, "out"), new_folder(spark, "state")
    changes = open_sessions.live_session_changes(stream(spark, df, "keys", files))
    open_sessions.start_session_changes(changes, path, checkpoint).awaitTermination()
    return open_sessions.latest_sessions(spark, path)


def test_open_sessions_are_the_batch_forms_sessions(spark):
    minutes = [0, 4, 14, 25, 26, 60, 61, 64, 66, 719, 725, 724, 730, 900, 905]
    rows = [(i, AS_OF + timedelta(minutes=m), "hot" if i % 2 else None) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "i int, Timestamp timestamp_ntz, App string")
    expected = active_sessions_by_app(df.withColumnRenamed("i", "event_id"))
    assert expected.count() >= 3 and expected.filter("App is null").count() > 0
    for files in (1, 4):
        found = run_sessions(spark, df, files)
        same_rows(found, expected, ["App", "session_date", "session_start", "session_end"])
        last = AS_OF + timedelta(minutes=905)
        for r in found.collect():
            assert r.is_open == (r.session_end + timedelta(minutes=10) >= last - timedelta(minutes=10))


def test_an_event_between_joins_two_open_sessions(spark):
    # In batches: two sessions, then the minute that joins them, then one too late to count, then one that closes all.
    minutes = [0, 1, 12, 13, 7, 40, 2, 90]
    rows = [(i, AS_OF + timedelta(minutes=m), "a") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "i int, Timestamp timestamp_ntz, App string")
    found = run_sessions(spark, df, 8).collect()
    assert [(r.session_start, r.session_end, r.is_open) for r in found] == [
        (AS_OF, AS_OF + timedelta(minutes=13), False)
    ]


def test_live_status_stays_readable_and_small_over_a_hundred_batches(spark):
    path, frame = new_folder(spark, "status"), spark.createDataFrame([(0,)], "event_count bigint")
    most = 0
    for number in range(100):
        upserts.put(frame.withColumn("event_count", F.lit(number).cast("bigint")), number, path, ())
        most = max(most, len(upserts.folders(spark, path)))
        if number % 20 == 7:
            assert jobs.latest_status(spark, path, frame.schema).first().event_count == number
    assert most <= 4 * upserts.EVERY


def test_live_status_keeps_the_latest(spark):
    rows = [(i, AS_OF + timedelta(minutes=i)) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, Timestamp timestamp_ntz")
    live = jobs.live_status(stream(spark, df, "status", 3))
    path, checkpoint = new_folder(spark, "out"), new_folder(spark, "state")
    jobs.start_status(live, path, checkpoint).awaitTermination()
    row = jobs.latest_status(spark, path, live.schema).collect()
    assert [tuple(r) for r in row] == [(AS_OF + timedelta(minutes=5), 6)]

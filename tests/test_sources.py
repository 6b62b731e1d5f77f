import glob
import json
import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import AS_OF
from tests.rows import same_rows
from typeflow.functions.keys import key_category
from typeflow.operators.evolution import add_tags
from typeflow.operators.sites import top_sites
from typeflow.plans import catalog
from typeflow.schema import KEY_EVENTS, RAW_REQUEST, TYPING_EVENTS
from typeflow.session import new_folder
from typeflow.sources.events import (
    append_events,
    ingest_batches,
    numbered_events,
    read_events,
    rejected_batches,
    store_batch,
    write_records,
)
from typeflow.sources.key_csv import key_preview, read_key_csv, write_key_csv
from typeflow.sources.tables import SCHEMAS

HEADER = "Timestamp,Interval_ns,SeqNum,App,Title,Category\n"


def event(**changes):
    base = {
        "record_time": "2024-03-10 11:59:00.123456",
        "session_id": "s1",
        "source_url": "google.com",
        "is_end_of_word": False,
        "is_end_of_line": False,
        "is_return": True,
    }
    return {**base, **changes}


def requests(spark, *bodies):
    rows = [("alice", "h", None, "en", b if isinstance(b, str) else json.dumps({"events": b})) for b in bodies]
    return spark.createDataFrame(rows, RAW_REQUEST)


def test_events_are_enriched(spark):
    batch = ingest_batches(requests(spark, [event(), event(session_id="s2")]))
    assert batch.columns == TYPING_EVENTS.names
    assert batch.schema["record_time"].dataType == TYPING_EVENTS["record_time"].dataType
    rows = batch.collect()
    assert {r.session_id for r in rows} == {"s1", "s2"}
    assert {r.agent_description for r in rows} == {"h##en"} and {r.user_id for r in rows} == {"alice"}
    assert len({r.batch_id for r in rows}) == 2 and all(len(r.batch_id) == 32 for r in rows)
    assert len({r.ingestion_time for r in rows}) == 1
    assert rows[0].record_time == datetime(2024, 3, 10, 11, 59, 0, 123456) and rows[0].is_return is True


def test_a_bad_event_refuses_its_request_only(spark):
    missing = event()
    del missing["source_url"]
    raw = requests(spark, [event(), missing], [event(record_time="soon")], "no json", [event()], [])
    assert ingest_batches(raw).count() == 1


@pytest.mark.parametrize(
    "text",
    [
        "2024-03-10T11:59:00Z",
        "2024-03-10T11:59:00.000+00:00",
        "2024-03-10 11:59:00",
        "2024-03-10T13:59:00+02:00",
        "2024-03-10T06:29:00.000-05:30",
        "2024-03-10T12:59:00 Europe/Paris",
        "2024-03-10T11:59Z",
        "2024-03-10 11:59",
        "2024-03-10T13:59+02:00",
        "2024-03-10T13:59+0200",
        "2024-03-10T12:59 Europe/Paris",
    ],
)
def test_times_with_a_zone_are_stored_as_utc(spark, text):
    assert ingest_batches(requests(spark, [event(record_time=text)])).first().record_time == datetime(2024, 3, 10, 11, 59)


def test_refused_requests_are_kept_with_their_reason(spark):
    raw = requests(spark, [event(record_time="soon")], "no json", [event()])
    assert sorted(r.reason for r in rejected_batches(raw).collect()) == ["event", "text"]


def test_appended_events_are_partitioned_by_date(spark, events):
    path = new_folder(spark, "events")
    ev = events([{"t": AS_OF - timedelta(days=d), "url": f"{d}.com"} for d in range(40)])
    append_events(ev.filter("keystroke_id < 20"), path)
    append_events(add_tags(ev.filter("keystroke_id >= 20")), path)
    stored = read_events(spark, path)
    assert stored.count() == 40 and stored.filter(F.col("tags").isNotNull()).count() == 0
    recent = top_sites(stored, AS_OF, "2 days")
    assert [r.url for r in recent.collect()] == ["0.com", "1.com"]
    scan = recent._jdf.queryExecution().executedPlan().toString()
    assert ">= 2024-03-08" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_tags_are_added_once(events):
    ev = add_tags(events([{"t": AS_OF}]))
    assert dict(ev.dtypes)["tags"] == "array<string>" and add_tags(ev) is ev


def test_records_sink(spark, events):
    path = new_folder(spark, "records")
    write_records(top_sites(events([{"t": AS_OF}]), AS_OF), path)
    assert [tuple(r) for r in spark.read.json(path).select("url", "event_count").collect()] == [("example.com", 1)]


def write_files(tmp_path, *texts):
    for i, text in enumerate(texts):
        (tmp_path / f"{1700000000 + i}.csv").write_text(HEADER + text)
    return str(tmp_path)


def test_csv_drops(spark, tmp_path):
    path = write_files(
        tmp_path,
        '2025-01-26T10:00:00.123+01:00,12345678901234567890,0,"Editor","a ""quoted"", title\nwith a break","Space"\n'
        '2025-01-26T09:00:01.5Z,1,0,"Mail","Untitled","Enter"\n',
        '2025-01-26T09:00:02Z,2,0,"Mail","x","Other"\n',
    )
    kev = read_key_csv(spark, path)
    assert kev.schema == KEY_EVENTS
    rows = sorted(kev.collect())
    assert [r.Timestamp for r in rows] == [
        datetime(2025, 1, 26, 9, 0, 0, 123000),
        datetime(2025, 1, 26, 9, 0, 1, 500000),
        datetime(2025, 1, 26, 9, 0, 2),
    ]
    assert rows[0].Title == 'a "quoted", title\nwith a break' and int(rows[0].Interval_ns) == 12345678901234567890
    local = read_key_csv(spark, path, "Europe/Zurich").agg(F.min("Timestamp")).first()[0]
    assert local == datetime(2025, 1, 26, 10, 0, 0, 123000)
    assert len(key_preview(kev, 2).collect()) == 2


def test_bad_rows_are_skipped_whatever_is_selected(spark, tmp_path):
    path = write_files(
        tmp_path,
        '2025-01-26T09:00:00Z,1,0,"A","t","Space"\n'
        '2025-01-26T09:00:01Z,1,0,"B"\n'
        'yesterday,1,0,"C","t","Space"\n'
        '2025-01-26T09:00:01Z,many,0,"D","t","Space"\n'
        '2025-01-26T09:00:01Z,1,0,"E","t","Space","extra"\n'
        '2025-01-26T09:00:02Z,2,0,"F","t","Enter"\n',
    )
    kev = read_key_csv(spark, path)
    assert sorted(r.App for r in kev.select("App").collect()) == ["A", "F"]
    assert kev.count() == 2
    assert kev.agg(F.max("Timestamp")).first()[0] == datetime(2025, 1, 26, 9, 0, 2)


def test_empty_cells_are_null_and_fit(spark, tmp_path):
    path = write_files(
        tmp_path,
        '2025-01-26T09:00:00Z,,0,"A","t","Space"\n'
        '2025-01-26T09:00:01Z,1,,"B","t",\n'
        ',1,0,"C","t","Space"\n'
        '2025-01-26T09:00:01Z,1,0,"D"\n',
    )
    rows = {r.App: r for r in read_key_csv(spark, path).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["A"].Interval_ns is None and rows["B"].SeqNum is None and rows["B"].Category is None
    assert rows["C"].Timestamp is None


def large_csv(tmp_path, seed):
    """Files with titles over many lines, quotes, empty lines, Windows line ends and bad rows."""
    rng = random.Random(seed)
    for i in range(3):
        end = "\r\n" if i == 1 else "\n"
        lines = [HEADER.strip()]
        for k in range(400):
            title = "".join(rng.choice(["x", " ", "\n", "\n\n", '""', ",", "é", "\n" * 40]) for _ in range(rng.choice([0, 3, 30])))
            row = f'2025-01-26T09:{k // 60:02d}:{k % 60:02d}Z,{k},{rng.choice(["", "0"])},"App{i}","{title}","Space"'
            lines.append(rng.choice([row] * 8 + ["", "short,row", row + ",extra", "tomorrow" + row[20:]]))
        lines.append('2025-01-26T10:00:00Z,1,0,"Last","' + "long\n" * 3000 + '","Space"')
        (tmp_path / f"{i}.csv").write_bytes((end.join(lines) + (end if i else "")).encode())
    return str(tmp_path)


@pytest.mark.parametrize("size", ["60", "777", "16k", "128m"])
def test_large_csv_files_are_read_by_many_tasks_with_the_same_rows(spark, tmp_path, size):
    path = large_csv(tmp_path, len(size))
    expected = read_key_csv(spark, path, split=False).collect()
    assert len(expected) > 800
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    try:
        for name in names:
            spark.conf.set(name, "16k" if size == "60" else size)
        if size == "60":
            spark.conf.set(names[0], "900")
            spark.conf.set(names[1], "1")
        found = read_key_csv(spark, path)
        assert sorted(found.collect(), key=str) == sorted(expected, key=str)
        assert found.filter("App = 'Last'").count() == 3
        if size != "128m":
            assert found.rdd.getNumPartitions() >= 3
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_csv_records_are_parsed_once_and_lines_go_to_python_once(spark, tmp_path):
    path = write_files(tmp_path, '2025-01-26T09:00:00Z,1,0,"A","t\nu","Space"\n' * 9, '2025-01-26T09:00:00Z,1,0,"A","t","Space"\n')
    kev = read_key_csv(spark, path)
    parsed = kev._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.count("from_csv(") == 1
    assert len(kev.collect()) == 10
    ran = kev._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert ran.count("MapInArrow") == 1  # no record reaches over a block's end, so no lines are read for pieces


def test_numbered_events_have_unique_ids_without_gaps_in_time_order(spark, events):
    rng = random.Random(2)
    ev = events([{"t": AS_OF - timedelta(seconds=rng.randint(0, 300)), "user": rng.choice("ab")} for _ in range(2000)])
    for column in ("ingestion_time timestamp_ntz", "batch_id string", "agent_description string"):
        name, kind = column.split()
        ev = ev.withColumn(name, F.lit(None).cast(kind))
    rows = sorted(numbered_events(ev, 50).select("keystroke_id", "record_time", "user_id").collect())
    assert [r.keystroke_id for r in rows] == list(range(50, 2050))
    assert [(r.record_time, r.user_id) for r in rows] == sorted((r.record_time, r.user_id) for r in rows)


def test_batches_go_on_numbering_and_a_repeated_one_keeps_its_ids(spark):
    path = new_folder(spark, "numbered")
    batches = [ingest_batches(requests(spark, [event(session_id=f"{n}-{k}") for k in range(3 + n)])) for n in range(5)]
    for n, batch in enumerate(batches):
        store_batch(batch, n, path)
        if n in (0, 3):
            first = sorted(r.keystroke_id for r in read_events(spark, path).collect())
            store_batch(batch, n, path)  # as after a failure
            assert sorted(r.keystroke_id for r in read_events(spark, path).collect()) == first
    rows = read_events(spark, path).collect()
    assert sorted(r.keystroke_id for r in rows) == list(range(1, 26))
    assert all(r.session_id.startswith("4-") for r in rows if r.keystroke_id > 18)
    store_batch(batches[0].limit(0), 5, path)
    store_batch(batches[0], 6, path)
    assert sorted(r.keystroke_id for r in read_events(spark, path).collect()) == list(range(1, 29))


def test_csv_round_trip_in_a_zone(spark):
    path = new_folder(spark, "csv")
    kev = spark.createDataFrame([(datetime(2025, 1, 26, 11), Decimal(1), 0, "A", "t", "Space")], KEY_EVENTS)
    write_key_csv(kev, path, zone="Europe/Paris")
    assert read_key_csv(spark, path).first().Timestamp == datetime(2025, 1, 26, 10)
    same_rows(read_key_csv(spark, path, "Europe/Paris"), kev, KEY_EVENTS.names)


def test_csv_round_trip(spark):
    path = new_folder(spark, "csv")
    rows = [
        (datetime(2025, 1, 26, 9, 0, 0, 123456), Decimal(2**64 - 1), 0, 'say "hi", all', " two\nlines ", "Space"),
        (datetime(2025, 1, 26, 9, 0, 1), Decimal(0), 0, None, None, "Other"),
    ]
    kev = spark.createDataFrame(rows, KEY_EVENTS)
    write_key_csv(kev, path, rows_per_file=1)
    assert read_key_csv(spark, path).count() == 2
    expected = kev.fillna({"App": "Unknown", "Title": "Untitled"})
    same_rows(read_key_csv(spark, path), expected, KEY_EVENTS.names)


def test_gzip_drops_are_read_as_plain_ones(spark, tmp_path):
    path = large_csv(tmp_path, 5)
    expected = read_key_csv(spark, path).collect()
    drops = new_folder(spark, "csv")
    write_key_csv(read_key_csv(spark, path), drops, rows_per_file=100, compressed=True)
    assert len(glob.glob(f"{drops}/*.csv.gz")) >= 8 and not glob.glob(f"{drops}/*.csv")
    for split in (True, False):
        found = read_key_csv(spark, drops, split=split).collect()
        defaults = [r.asDict() | {"Title": r.Title or "Untitled"} for r in expected]
        assert sorted(map(str, (r.asDict() for r in found))) == sorted(map(str, defaults))


def test_the_drops_of_key_events_with_gaps_take_less_disk_than_their_titles(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices('abcdef ",\n', k=2000)) for _ in range(200)]
    documents = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts)]
    events = [(i, AS_OF + timedelta(seconds=i), i % 7, "click", 1.0, None) for i in range(200)]
    for name, rows in (("documents", documents), ("events", events)):
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(catalog, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    kev = catalog.queries()["q38_key_csv_gaps"](spark, str(tmp_path))
    found = {r.Timestamp: r for r in kev.collect()}
    assert [found[AS_OF + timedelta(seconds=i)].Title for i in range(200)] == [f'"a", {text}' for text in texts]
    assert [r.SeqNum for _, r in sorted(found.items())] == [0 if i % 3 else None for i in range(200)]
    written = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/key-csv-gaps/part-*"))
    assert 0 < written < 0.7 * sum(map(len, texts))


@pytest.mark.parametrize(
    ("kind", "code", "category"),
    [
        ("keyDown", 49, "Space"),
        ("keyDown", 36, "Enter"),
        ("keyDown", 76, "Enter"),
        ("keyDown", 0, "Alphanumeric"),
        ("keyDown", 10, "Other"),
        ("keyDown", 29, "Other"),
        ("keyDown", 126, "Alphanumeric"),
        ("keyDown", 127, "Other"),
        ("flagsChanged", 49, "Modifier"),
        ("keyUp", 49, "Other"),
    ],
)
def test_key_categories(spark, kind, code, category):
    df = spark.createDataFrame([(kind, code)], "kind string, code long")
    assert df.select(key_category(F.col("kind"), F.col("code"))).first()[0] == category

"""Streaming forms of ingestion, counters, sessions and status.

All jobs default to ``availableNow``: they process what is there and stop; pass ``trigger`` to keep one running.
State and progress live in the given checkpoint folder, so a job that lost its driver or executors resumes there.
Windows are aligned to the clock, not to the moment of asking as in the batch form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from typeflow.schema import RAW_REQUEST
from typeflow.sources.events import ingest_batches, store_batch
from typeflow.streaming.upserts import ONCE, latest, start_upserts


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _start(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)


def ingest_stream(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    trigger: dict = ONCE,
    ingestion_time: Column | None = None,
    batch_id: Column | None = None,
) -> StreamingQuery:
    """Logged requests (JSON lines) stored in the date-partitioned event table, each file once.

    Events get unique ids that go on from batch to batch; a table belongs to one checkpoint.
    """
    raw = spark.readStream.schema(RAW_REQUEST).json(source)
    return (
        ingest_batches(raw, ingestion_time, batch_id)
        .writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark needs times with a zone: in a UTC session they are the same instants."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_counts(ev: DataFrame, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and corrections per user and tumbling window.

    :func:`start_append` writes a window once the watermark has passed it, :func:`start_counts` at once and whenever it
    grows.
    """
    return (
        _event_time(ev, "record_time", delay)
        .groupBy("user_id", F.window("record_time", width).alias("w"))
        .agg(F.count("*").alias("event_count"), F.count_if(F.col("is_return")).alias("error_count"))
        .select(
            "user_id",
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "event_count",
            "error_count",
        )
    )


def live_sessions(kev: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per app and date, out once the watermark has passed them; without session numbers.

    ``streaming.open_sessions`` also gives the sessions that are still open.
    """
    return (
        _event_time(kev, "Timestamp", delay)
        .groupBy("App", F.to_date("Timestamp").alias("session_date"), F.session_window("Timestamp", gap).alias("w"))
        .agg(F.min("Timestamp").alias("session_start"), F.max("Timestamp").alias("session_end"))
        .filter(F.col("session_end") > F.col("session_start"))
        .select(
            "App",
            "session_date",
            F.col("session_start").cast("timestamp_ntz").alias("session_start"),
            F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        )
    )


def live_status(kev: DataFrame) -> DataFrame:
    """Time of the last event and number of events so far."""
    return kev.agg(F.max("Timestamp").alias("last_event"), F.count("*").alias("event_count"))


def start_append(df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Write finished rows of a live table to parquet."""
    return _start(df, path, checkpoint, trigger)


def start_sessions(df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """As :func:`start_append`; sessions are merged before the shuffle, so a busy app sends few rows."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = conf.get(name, None)
    conf.set(name, "true")  # the query keeps the settings it was started with
    try:
        return _start(df, path, checkpoint, trigger)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


#: A live count's key, for :func:`typeflow.streaming.upserts.latest`.
COUNT_KEYS = ("user_id", "window_start")


def start_counts(df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keeps :func:`live_counts` as they grow, windows that are still open included; see :func:`latest_counts`."""
    return start_upserts(df, path, checkpoint, COUNT_KEYS, trigger)


def latest_counts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest counts of every user and window."""
    return latest(spark, path, schema, COUNT_KEYS)


def start_status(df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keeps the one row of a global aggregate; see :func:`latest_status`."""
    return start_upserts(df, path, checkpoint, (), trigger)


def latest_status(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest result below ``path``."""
    return latest(spark, path, schema, ())

"""The given test tables seen as typing and key events (the mappings are listed in FIXTURES.md)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeflow.functions.time import epoch_micros, from_micros, micros
from typeflow.session import use_utc

AS_OF = datetime(2024, 1, 31)
FAST_START = datetime(2024, 1, 1)
FAST_FACTOR = 500
FAST_AS_OF = datetime(2024, 1, 1, 1, 30)


# Given, so that opening a table needs no job that looks into its files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _typing(spark: SparkSession, sf_dir: str, page_of, record_time) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("page_id", page_of)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    kind = F.col("event_type")
    return events.join(pages, "page_id", "left").select(
        F.col("event_id").alias("keystroke_id"),
        record_time.alias("record_time"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("session_id"),
        F.col("url").alias("source_url"),
        (kind == "click").alias("is_end_of_word"),
        (kind == "purchase").alias("is_end_of_line"),
        (kind == "error").alias("is_return"),
    )


def typing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over all pages."""
    pages = table(spark, sf_dir, "pages").select(F.count("*")).scalar()
    return _typing(spark, sf_dir, F.col("event_id") % pages, F.col("ts"))


def typing_events_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with time running 500 times faster, on seven pages, so that they form flows."""
    use_utc(spark)
    start = epoch_micros(FAST_START)
    passed = F.call_function("div", micros("ts") - F.lit(start), F.lit(FAST_FACTOR))
    return _typing(spark, sf_dir, F.col("user_id") % 7, from_micros(F.lit(start) + passed))


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("Timestamp"),
        F.lit(0).cast("decimal(20,0)").alias("Interval_ns"),
        F.lit(0).alias("SeqNum"),
        F.col("event_type").alias("App"),
        F.lit(None).cast("string").alias("Title"),
        F.lit("Alphanumeric").alias("Category"),
    )


def key_events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key events with empty cells, and titles with quotes, commas and line breaks: the texts of documents."""
    documents = table(spark, sf_dir, "documents")
    count = documents.select(F.count("*")).scalar()
    titles = documents.select("doc_id", F.concat(F.lit('"a", '), F.col("text")).alias("said"))
    kev = key_events(spark, sf_dir).withColumn("doc_id", F.col("event_id") % count)
    return kev.join(titles, "doc_id", "left").select(
        "event_id",
        "Timestamp",
        F.when(F.col("event_id") % 5 != 0, F.col("Interval_ns")).alias("Interval_ns"),
        F.when(F.col("event_id") % 3 != 0, F.col("SeqNum")).alias("SeqNum"),
        "App",
        F.col("said").alias("Title"),
        F.when(F.col("event_id") % 7 != 0, F.col("Category")).alias("Category"),
    )


def raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key records before they are categorised."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 < 2, "keyDown").otherwise("flagsChanged").alias("kind"),
        (F.col("event_id") % 128).alias("keycode"),
    )


def raw_requests(spark: SparkSession, sf_dir: str, batch_size: int = 50, zoned: bool = False) -> DataFrame:
    """Requests as clients would have posted them: up to ``batch_size`` consecutive events of a user in each.

    With ``zoned``, every third time has no zone, every third a Z and every third is that of a clock two hours ahead.
    """
    ev = typing_events(spark, sf_dir)
    text, third = F.col("record_time").cast("string"), F.col("keystroke_id") % 3
    if zoned:
        ahead = (F.col("record_time") + F.expr("interval 2 hours")).cast("string")
        text = F.when(third == 0, text).when(third == 1, F.concat(text, F.lit("Z"))).otherwise(F.concat(ahead, F.lit("+02:00")))
    event = F.struct(
        text.alias("record_time"),
        "session_id",
        "source_url",
        "is_end_of_word",
        "is_end_of_line",
        "is_return",
    )
    batches = ev.groupBy("user_id", F.call_function("div", F.col("keystroke_id"), F.lit(batch_size)).alias("batch"))
    return batches.agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("body")).select(
        "user_id",
        F.lit("example.com").alias("host"),
        F.concat(F.lit("agent/"), F.col("batch") % 3).alias("user_agent"),
        F.when(F.col("batch") % 2 == 0, "en").alias("accept_language"),
        "body",
    )

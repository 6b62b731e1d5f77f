"""The typing event table as date-partitioned parquet, and posted batches of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeflow.functions.text import agent_description
from typeflow.operators.common import DATE_PARTITION
from typeflow.schema import POSTED_BATCH, TYPING_EVENTS
from typeflow.session import exists, new_folder, remove

STORED_EVENTS = T.StructType(
    [
        *TYPING_EVENTS.fields,
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField(DATE_PARTITION, T.DateType()),
    ]
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored table. Columns added later (``tags``) read as NULL from older files, without merging footers."""
    return spark.read.schema(STORED_EVENTS).parquet(path).drop(BATCH_PARTITION)


def with_date(ev: DataFrame) -> DataFrame:
    return ev.withColumn(DATE_PARTITION, F.to_date("record_time"))


def append_events(ev: DataFrame, path: str) -> None:
    """Append to the stored table. Adaptive execution evens out the file sizes, a very full date included."""
    with_date(ev).hint("rebalance", DATE_PARTITION).write.mode("append").partitionBy(DATE_PARTITION).parquet(path)


# What events of a batch are numbered by: their ids ascend with time.
ID_ORDER = ("record_time", "user_id", "session_id", "source_url")


def _staged(ev: DataFrame, folder: str) -> DataFrame:
    """Events sorted over ranges of :data:`ID_ORDER` and written, with each row's place in its range."""
    spark = ev.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev.repartitionByRange(ranges, *ID_ORDER).sortWithinPartitions(*ID_ORDER).select(
        "*",
        F.spark_partition_id().alias("_range"),
        # The lower 33 bits count the rows of a task.
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    ).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def _with_ids(staged: DataFrame, first_id: int) -> DataFrame:
    """Each range gets a block of ids as long as its rows, behind the blocks of the ranges before."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    blocks = staged.groupBy("_range").agg(F.count("*").alias("n"))
    blocks = blocks.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.lit(first_id).cast("bigint") + F.col("_before") + F.col("_row")
    return (
        staged.join(F.broadcast(blocks), "_range")
        .withColumn("keystroke_id", number)
        .drop("_range", "_row", "_before")
        .select(*TYPING_EVENTS.names)
    )


def numbered_events(ev: DataFrame, first_id: int = 1) -> DataFrame:
    """``ev`` with ids from ``first_id`` on, without gaps, in the order of time and then of user, session and URL.

    The events are stored on the way, so that each keeps its id whatever is computed again.
    """
    return _with_ids(_staged(ev, new_folder(ev.sparkSession, "numbered")), first_id)


#: Batches whose ids are noted at most: the last one is what the next goes on from.
_NOTED = 3


def _handed_out(spark: SparkSession, notes: str, number: int, count: int) -> int:
    """The first id of a batch's block. A repeated batch gets the block it had."""

    def note(batch: int) -> str:
        return f"{notes}/batch-{batch}"

    if exists(spark, f"{note(number)}/_SUCCESS"):
        return spark.read.parquet(note(number)).first().first_id
    first = 1
    if number > 0:
        last = spark.read.parquet(note(number - 1)).first()
        first = last.first_id + last.n
    spark.createDataFrame([(first, count)], "first_id bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(note(number))
    if number >= _NOTED:
        remove(spark, note(number - _NOTED))
    return first


#: Partition of a table that is filled batch by batch.
BATCH_PARTITION = "ingest_batch"


def store_batch(ev: DataFrame, number: int, path: str) -> None:
    """Stores batch ``number`` (0, 1, ...) of a table and gives its events the next block of ids.

    A batch that is repeated, after a failure at whatever point, replaces what it had stored and keeps its ids.
    """
    spark, notes = ev.sparkSession, f"{path}/_ids"
    folder = f"{notes}/staged-{number % 2}"
    staged = _staged(ev, folder)
    stored = _with_ids(staged, _handed_out(spark, notes, number, staged.count()))
    (
        with_date(stored)
        .withColumn(BATCH_PARTITION, F.lit(number).cast("bigint"))
        .hint("rebalance", DATE_PARTITION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DATE_PARTITION, BATCH_PARTITION)
        .parquet(path)
    )
    remove(spark, folder)


def write_records(df: DataFrame, path: str) -> None:
    """Query results as JSON records."""
    df.write.mode("overwrite").json(path)


# A time of day and behind it a zone: Z, an offset, or a name.
_ZONED = r"\d:\d\d(:\d\d(\.\d+)?)?\s*([Zz]|UTC|GMT|[+-]\d{1,2}(:?\d\d){0,2}|[A-Za-z]+/[A-Za-z_/]+)$"


# A time of day without seconds, at the end or before a zone.
_TO_THE_MINUTE = r"([T\s]\d{1,2}:\d\d)(?=\s*($|[Zz+-]|UTC|GMT|[A-Za-z]+/))"


def stored_time(text: Column) -> Column:
    """Posted time as it is stored: with a zone, the instant's UTC time; without one, as it is; NULL if it is none."""
    text = F.regexp_replace(text, _TO_THE_MINUTE, "$1:00")
    instant = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.when(text.rlike(_ZONED), F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)).otherwise(
        text.try_cast("timestamp_ntz")
    )


def _posted() -> Column:
    return F.from_json("body", POSTED_BATCH)["events"]


def _whole(events: Column) -> Column:
    """Whether a request's text parses and no event lacks a field."""

    def complete(event: Column) -> Column:
        ok = stored_time(event["record_time"]).isNotNull()
        for field in POSTED_BATCH["events"].dataType.elementType.names:
            ok = ok & event[field].isNotNull()
        return ok

    return events.isNotNull() & F.forall(events, complete)


def rejected_batches(raw: DataFrame) -> DataFrame:
    """The requests that :func:`ingest_batches` refuses, with the ``reason``: ``text`` or ``event``."""
    reason = F.when(F.col("events").isNull(), "text").when(~_whole(F.col("events")), "event")
    return raw.withColumn("events", _posted()).withColumn("reason", reason).filter("reason is not null").drop("events")


def ingest_batches(
    raw: DataFrame,
    ingestion_time: Column | None = None,
    batch_id: Column | None = None,
    keystroke_id: Column | None = None,
) -> DataFrame:
    """Typed events from logged requests (see ``schema.RAW_REQUEST``).

    A request counts as a whole: if its text does not parse, or one event lacks a field, none of its events is
    taken; :func:`rejected_batches` has these. Times with a zone or offset are stored as UTC, times without one as they
    are. ``ingestion_time`` defaults to the current time, ``batch_id`` to a fresh hexadecimal uuid for each event
    and ``keystroke_id`` to a hash of the batch id; :func:`numbered_events` and :func:`store_batch` replace it. Given expressions may use the posted fields and ``user_id``.
    """
    events = (
        raw.withColumn("events", _posted())
        .filter(_whole(F.col("events")))
        .withColumn(
            "agent_description", agent_description(F.col("host"), F.col("user_agent"), F.col("accept_language"))
        )
        .select("user_id", "agent_description", F.explode("events").alias("event"))
        .select("user_id", "agent_description", "event.*")
        .withColumn("record_time", stored_time(F.col("record_time")))
    )
    if ingestion_time is None:
        ingestion_time = F.current_timestamp()
    if batch_id is None:
        batch_id = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    if keystroke_id is None:
        keystroke_id = F.xxhash64("batch_id")
    return (
        events.withColumn("ingestion_time", ingestion_time.cast("timestamp_ntz"))
        .withColumn("batch_id", batch_id)
        .withColumn("keystroke_id", keystroke_id)
        .select(*TYPING_EVENTS.names)
    )

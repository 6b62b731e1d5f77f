"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_NTZ = T.TimestampNTZType()

TYPING_EVENTS = T.StructType(
    [
        T.StructField("keystroke_id", T.LongType()),
        T.StructField("record_time", _NTZ),
        T.StructField("ingestion_time", _NTZ),
        T.StructField("batch_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("agent_description", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("is_end_of_word", T.BooleanType()),
        T.StructField("is_end_of_line", T.BooleanType()),
        T.StructField("is_return", T.BooleanType()),
    ]
)

# One event as a client posts it. The time is text; a zone in it is dropped when it is stored.
POSTED_EVENT = T.StructType(
    [
        T.StructField("record_time", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("is_end_of_word", T.BooleanType()),
        T.StructField("is_end_of_line", T.BooleanType()),
        T.StructField("is_return", T.BooleanType()),
    ]
)

POSTED_BATCH = T.StructType([T.StructField("events", T.ArrayType(POSTED_EVENT))])

# One request as it is logged: who sent it, with which headers, and the batch text.
RAW_REQUEST = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("accept_language", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

KEY_EVENTS = T.StructType(
    [
        T.StructField("Timestamp", _NTZ),
        T.StructField("Interval_ns", T.DecimalType(20, 0)),
        T.StructField("SeqNum", T.IntegerType()),
        T.StructField("App", T.StringType()),
        T.StructField("Title", T.StringType()),
        T.StructField("Category", T.StringType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)

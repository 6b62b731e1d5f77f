from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from typeflow.session import build_session  # noqa: E402

AS_OF = datetime(2024, 3, 10, 12, 0, 0)

EVENT_SCHEMA = (
    "keystroke_id bigint, record_time timestamp_ntz, user_id string, session_id string, source_url string, "
    "is_end_of_word boolean, is_end_of_line boolean, is_return boolean"
)
KEY_SCHEMA = "event_id bigint, Timestamp timestamp_ntz, App string"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "typeflow-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Builds typing events from dicts with at least ``t``."""

    def build(rows):
        data = [
            (
                i,
                row["t"],
                row.get("user", "alice"),
                row.get("session", "1"),
                row.get("url", "example.com"),
                row.get("word", False),
                row.get("line", False),
                row.get("error", False),
            )
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(data, EVENT_SCHEMA)

    return build


@pytest.fixture
def keys(spark):
    """Builds key events from (time, app) pairs."""

    def build(rows):
        return spark.createDataFrame([(i, t, app) for i, (t, app) in enumerate(rows)], KEY_SCHEMA)

    return build

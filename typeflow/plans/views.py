"""The desktop client's stored views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from typeflow.operators.sessions import active_sessions, active_sessions_by_app


def create_views(kev: DataFrame, as_of=None) -> None:
    """Register key_events, active_sessions_by_app and active_sessions for use from SQL."""
    kev.createOrReplaceTempView("key_events")
    active_sessions_by_app(kev).createOrReplaceTempView("active_sessions_by_app")
    active_sessions(kev, as_of).createOrReplaceTempView("active_sessions")

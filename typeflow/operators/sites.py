"""Where people type: counts per host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.functions.text import host
from typeflow.operators.common import looking_back


def with_host(ev: DataFrame, name: str = "url") -> DataFrame:
    """Events that have a host, with the host as a column."""
    return ev.withColumn(name, host(F.col("source_url"))).filter(F.col(name).isNotNull())


def site_counts(ev: DataFrame, name: str = "event_count") -> DataFrame:
    """Events per host, busiest first."""
    return with_host(ev).groupBy("url").agg(F.count("*").alias(name)).orderBy(F.desc(name), "url")


def top_sites(
    ev: DataFrame, as_of=None, lookback="1 month", n: int = 10, user: str | None = None, name: str = "event_count"
) -> DataFrame:
    """The ``n`` busiest hosts of the period; equal counts go by name."""
    return site_counts(looking_back(ev, as_of, lookback, user), name).limit(n)


def site_reach(ev: DataFrame, pattern: str = "%google%", approximate: bool = False) -> DataFrame:
    """Events and distinct users per host matching a case-insensitive LIKE pattern."""
    users = F.approx_count_distinct("user_id") if approximate else F.count_distinct("user_id")
    return (
        with_host(ev)
        .filter(F.lower("url").like(pattern.lower()))
        .groupBy("url")
        .agg(F.count("*").alias("event_count"), users.alias("user_count"))
    )


def site_users(ev: DataFrame, pattern: str = "%google%") -> DataFrame:
    """Events per host and user, for hosts matching a case-insensitive LIKE pattern."""
    return (
        with_host(ev)
        .filter(F.lower("url").like(pattern.lower()))
        .groupBy("url", "user_id")
        .agg(F.count("*").alias("event_count"))
    )


def host_sample(ev: DataFrame, n: int = 10) -> DataFrame:
    """Hosts of the first ``n`` events; events without a host drop out after the limit."""
    first = ev.select("keystroke_id", "source_url").orderBy("keystroke_id").limit(n)
    return with_host(first).select("url")

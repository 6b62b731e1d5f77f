"""Text expressions: host of a URL, readable durations, agent description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scheme and user part are optional, the host is the first group.
HOST_PATTERN = r"^(?:https?:\/\/)?(?:[^@\/\n]+@)?([^:\/\n]+)"

# Request headers that describe the agent, in this order.
AGENT_HEADERS = ("host", "user-agent", "accept-language")


def host(url: Column | str) -> Column:
    """Host of a URL; NULL where there is none."""
    found = F.regexp_extract(url, HOST_PATTERN, 1)
    return F.when(found != "", found)


def duration_text(seconds: Column) -> Column:
    """'1h 2min 3s' with empty parts left out; '' for nothing."""
    whole = F.floor(seconds).cast("long")
    hours = F.call_function("div", whole, F.lit(3600))
    minutes = F.call_function("div", F.pmod(whole, F.lit(3600)), F.lit(60))
    rest = F.pmod(whole, F.lit(60))
    return F.concat_ws(
        " ",
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("min"))),
        F.when(rest > 0, F.concat(rest.cast("string"), F.lit("s"))),
    )


def agent_description(*headers: Column) -> Column:
    """Header values joined by '#', missing ones as empty text."""
    return F.concat_ws("#", *[F.coalesce(value, F.lit("")) for value in headers])


def clock_label(hour: Column, minute: Column, padded: bool = True) -> Column:
    """'09:05', or '9:5' when not padded."""
    parts = [part.cast("string") for part in (hour, minute)]
    if padded:
        parts = [F.lpad(part, 2, "0") for part in parts]
    return F.concat_ws(":", *parts)

"""Live sessions, open ones included, by a stateful processor with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from typeflow.functions.time import fixed_micros, from_micros, micros
from typeflow.operators.islands import day_divisor
from typeflow.streaming.upserts import ONCE, latest, start_upserts

KEYS = ("App", "session_date", "lo")
_RUN = "lo bigint, hi bigint"
_CHANGES = "App string, session_date date, lo bigint, hi bigint, is_open boolean, replaced boolean"


def merged(runs: Sequence[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Runs (first and last moment) joined where no more than ``gap`` lies between."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class OpenSessions(StatefulProcessor):
    """The open sessions of one app and date.

    The state holds runs that events can still reach. New events extend or join them; a run is closed, and leaves the
    state, once the watermark is a pause behind its end. Rows given out are the changes: a session as it is now, closed
    for good, or replaced because events joined it to an earlier one.
    """

    def __init__(self, gap: int):
        self._gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._runs = handle.getListState("runs", _RUN)

    def _closing(self, hi: int) -> int:
        """The first millisecond at which a run that ended at ``hi`` can't be reached any more."""
        return (hi + self._gap) // 1000 + 1

    def _changes(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(
                {
                    "App": pd.Series([key[0]] * len(rows), dtype=object),
                    "session_date": [key[1]] * len(rows),
                    "lo": [row[0] for row in rows],
                    "hi": [row[1] for row in rows],
                    "is_open": [row[2] for row in rows],
                    "replaced": [row[3] for row in rows],
                }
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(map(int, run)) for run in self._runs.get()] if self._runs.exists() else []
        new = list(known)
        for part in rows:
            # Merged as they come, so that no more than the open runs are held.
            new = merged([*new, *zip(part["lo"].tolist(), part["hi"].tolist())], self._gap)
        self._runs.put(new)
        changed = [run for run in new if run not in known]
        for _, hi in changed:
            self._handle.registerTimer(self._closing(hi))
        starts = {lo for lo, _ in new}
        gone = [(lo, hi, False, True) for lo, hi in known if lo not in starts]
        yield from self._changes(key, [(lo, hi, True, False) for lo, hi in changed] + gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = [tuple(map(int, run)) for run in self._runs.get()] if self._runs.exists() else []
        closed = [run for run in known if self._closing(run[1]) <= now]
        left = [run for run in known if self._closing(run[1]) > now]
        if left:
            self._runs.put(left)
        else:
            self._runs.clear()
        yield from self._changes(key, [(*run, False, False) for run in closed])

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last moment of each app, date and slice in a batch of events: what the shuffle then carries."""
    for batch in batches:
        groups = batch.groupby(["App", "session_date", "slice"], dropna=False, sort=False)["us"]
        yield groups.agg(lo="min", hi="max").reset_index()[["App", "session_date", "lo", "hi"]]


def live_session_changes(kev: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """What changes in the sessions per app and date, for :func:`start_session_changes`.

    Events that come later than ``delay`` after the newest one are dropped. Inside a task events are first reduced to
    slices no wider than the pause, so a busy app sends few rows.
    """
    width = fixed_micros(gap)
    slices = (
        kev.filter("Timestamp is not null")
        .select("App", F.to_date("Timestamp").alias("session_date"), micros("Timestamp").alias("us"))
        .withColumn("slice", F.col("us") - F.pmod("us", F.lit(day_divisor(width))))
        .mapInPandas(_combined, "App string, session_date date, lo bigint, hi bigint")
        .withColumn("moment", F.timestamp_micros("hi"))
        .withWatermark("moment", delay)
    )
    return slices.groupBy("App", "session_date").transformWithStateInPandas(
        OpenSessions(width), _CHANGES, "Update", "eventTime"
    )


def start_session_changes(df: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Keeps the changes below ``path``. State is held by RocksDB, so it may exceed the memory of executors."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query keeps the settings it was started with
        return start_upserts(df, path, checkpoint, KEYS, trigger)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def latest_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions so far that last longer than a moment, and whether events can still extend them."""
    rows = latest(spark, path, StructType.fromDDL(_CHANGES), KEYS).filter("not replaced and hi > lo")
    return rows.select(
        "App",
        "session_date",
        from_micros(F.col("lo")).alias("session_start"),
        from_micros(F.col("hi")).alias("session_end"),
        "is_open",
    )

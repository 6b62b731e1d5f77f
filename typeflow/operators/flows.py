"""Typing speed: flows of events without a pause, per time window or per time of day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.functions.text import clock_label
from typeflow.functions.time import (
    MINUTE,
    Span,
    bin_in_day,
    epoch_micros,
    fixed_micros,
    floor_to,
    from_micros,
    hour_part,
    micros,
    minute_of_day,
    minute_part,
    resolve,
    shift,
    span,
)
from typeflow.operators.common import looking_back
from typeflow.operators.islands import slices


def _last_start(us: Column, starts: list[int]) -> Column:
    """The last of ``starts`` that isn't after ``us``, which isn't before the first: halved by a comparison each time."""
    if len(starts) == 1:
        return F.lit(starts[0]).cast("long")
    half = len(starts) // 2
    return F.when(us < F.lit(starts[half]), _last_start(us, starts[:half])).otherwise(_last_start(us, starts[half:]))


class WindowSpine:
    """Window starts ``as_of - lookback + k * resolution`` up to ``as_of``, in microseconds.

    An event's window is computed from its time, without a join. Month steps are added one after the other, so
    a step that was clamped to a short month stays clamped; their few starts are literals in the plan.
    """

    def __init__(self, now: datetime, lookback: Span, resolution: Span):
        if resolution.months <= 0 and resolution.micros <= 0:
            raise ValueError("the resolution must be positive")
        start = shift(now, lookback, -1)
        self.now = epoch_micros(now)
        self.first = epoch_micros(start)
        self.step = resolution.micros if resolution.fixed else None
        if self.step is not None:
            self.last = self.first + (self.now - self.first) // self.step * self.step
            self.end = self.last + self.step
            return
        self.starts = []
        while start <= now:
            self.starts.append(epoch_micros(start))
            start = shift(start, resolution)
        self.last = self.starts[-1]
        self.end = epoch_micros(start)

    def window_of(self, us: Column) -> Column:
        """Start of the window holding ``us``; NULL outside the spine."""
        inside = (us >= F.lit(self.first)) & (us < F.lit(self.end))
        if self.step is not None:
            return F.when(inside, floor_to(us, self.step, self.first))
        return F.when(inside, _last_start(us, self.starts))

    def between(self, low: Column, until: Column | None) -> Column:
        """Starts from ``low`` up to, but without, ``until`` (NULL: to the end of the spine)."""
        until = F.coalesce(until, F.lit(self.end))
        if self.step is not None:
            return F.sequence(low, until - F.lit(self.step), F.lit(self.step).cast("long"))
        return F.filter(F.array(*[F.lit(s) for s in self.starts]), lambda s: (s >= low) & (s < until))


def _flow_stats(ev: DataFrame, spine: WindowSpine, gap: int, ms: str) -> DataFrame:
    """Flows of at least two events per window, URL and session, with their mean interval in milliseconds.

    Intervals inside a slice sum up to ``hi - lo`` and the one to the next slice is ``lead(lo) - hi``, so the mean
    over a flow's events, which includes the pause that ends it, needs no event-level window.
    """
    if ms not in ("field", "elapsed"):
        raise ValueError("ms must be 'field' or 'elapsed'")
    keys = ["user_id", "window_us", "source_url", "session_id"]
    us = micros("record_time")
    # The seconds field wraps at a minute: slices stay below one so that only slice-to-slice intervals can wrap.
    width = min(gap, MINUTE) if ms == "field" else gap
    placed = ev.withColumn("window_us", spine.window_of(us)).filter(F.col("window_us").isNotNull())
    pieces = slices(
        placed, keys, us, width, spine.first, [F.sum(F.col("is_return").cast("int")).alias("errors")]
    )
    order = f"(partition by {', '.join(keys)} order by lo)"
    after = "after % 60000000" if ms == "field" else "after"
    return (
        pieces.selectExpr(
            "*",
            f"lead(lo) over {order} - hi as after",
            f"cast(coalesce(lo - lag(hi) over {order} > {gap}, false) as bigint) as opens",
        )
        .selectExpr("*", f"sum(opens) over {order} as flow_id")
        .groupBy(*keys, "flow_id")
        .agg(
            F.expr("sum(n) as n"),
            F.expr("sum(errors) as errors"),
            F.expr(f"sum(hi - lo + coalesce({after}, 0)) as us"),
            F.expr("sum(n - if(after is null, 1, 0)) as intervals"),
        )
        .filter("n > 1")
        .withColumn("avg_ms", F.expr("us / 1000D / intervals"))
    )


def typing_speed(
    ev: DataFrame,
    as_of: datetime | str | None = None,
    lookback="6 hours",
    resolution="15 minutes",
    flow_gap="5 seconds",
    user: str | None = None,
    ms: str = "field",
    newest_first: bool = True,
) -> DataFrame:
    """Typing speed, its volatility and errors per user and time window, zero-filled for windows without flows.

    Users without any flow do not appear. ``ms='field'`` counts only the seconds field of an interval (a pause of
    65.1 s adds 5100 ms to the flow it ends), ``ms='elapsed'`` its whole length.
    """
    now = resolve(as_of)
    spine = WindowSpine(now, span(lookback), span(resolution))
    recent = looking_back(ev, now, lookback, user, inclusive=True)
    stats = (
        _flow_stats(recent, spine, fixed_micros(flow_gap), ms)
        .groupBy("user_id", "window_us")
        .agg(
            F.expr("sum(avg_ms * n) / sum(n) as speed"),
            F.expr("coalesce(stddev_samp(avg_ms), 0D) as volatility"),
            F.expr("sum(n) as event_count"),
            F.expr("coalesce(sum(errors), 0L) as error_count"),
        )
    )
    # Each window also stands for the empty ones up to the user's next window; the first for those before it too.
    own = "(partition by user_id order by window_us)"
    filled = (
        stats.selectExpr(
            "*",
            f"if(lag(window_us) over {own} is null, {spine.first}L, window_us) as low",
            f"lead(window_us) over {own} as until",
        )
        .select("*", F.explode(spine.between(F.col("low"), F.col("until"))).alias("start_us"))
        .filter(F.col("start_us") < spine.now)
    )
    here = "start_us = window_us"
    return filled.select(
        "user_id",
        from_micros(F.col("start_us")).alias("window_start"),
        F.expr(f"if({here}, speed, null) as speed"),
        F.expr(f"if({here}, volatility, 0D) as volatility"),
        F.expr(f"if({here}, event_count, 0L) as event_count"),
        F.expr(f"if({here}, error_count, 0L) as error_count"),
        F.expr(f"if({here}, error_count / event_count, 0D) as relative_error"),
    ).orderBy(F.desc("window_start") if newest_first else F.asc("window_start"), "user_id")


def speed_by_time_of_day(
    ev: DataFrame,
    as_of: datetime | str | None = None,
    lookback="3 days",
    flow_gap="5 seconds",
    min_events: int = 5,
    width="15 minutes",
    by_user: bool = False,
    padded: bool = False,
) -> DataFrame:
    """Mean typing speed per time-of-day label, slowest label last.

    An event's interval runs to the next event of its session on any URL; flows are kept per URL and session. An
    event followed by a pause opens the next flow number of its URL; only intervals below the pause count.

    Events are shuffled and sorted once, by session and slice of the pause's width. Inside a slice only the last event's
    interval can exceed the pause, so a slice is summed up in one row per URL: its intervals, and its last event, whose
    interval is known once the session's next slice is. These rows are ordered per session to find it, and then per URL
    to carry the breaks on; both keep the one exchange of them.
    """
    gap = fixed_micros(flow_gap)
    if gap <= 0:
        raise ValueError("the pause must be positive")
    users = ["user_id"] if by_user else []
    session = [*users, "session_id"]
    site = [*session, "source_url"]
    whole = Window.partitionBy(*session, "slice")
    in_slice = whole.orderBy("us", "keystroke_id")
    followed = (
        looking_back(ev, as_of, lookback)
        .select(*site, "keystroke_id", micros("record_time").alias("us"))
        .filter("us is not null")
        .withColumn("slice", floor_to(F.col("us"), gap))
        .withColumn("next_us", F.lead("us").over(in_slice))
        .withColumn("first_us", F.min("us").over(whole))
        .withColumn("end_us", F.max("us").over(whole))
    )
    # Events of the last moment that the last event's URL also has share its fate: they come after its break.
    inner = F.col("us") < F.col("end_us")
    last = F.col("next_us").isNull()
    slices_of_sites = followed.groupBy(*site, "slice").agg(
        F.first("first_us").alias("first_us"),
        F.sum(F.when(inner, F.col("next_us") - F.col("us")).otherwise(0)).alias("inner_us"),
        F.count_if(inner).alias("inner_count"),
        F.min(F.when(inner, F.col("us"))).alias("inner_from"),
        F.count_if(~inner & ~last).alias("beside"),
        F.max(F.when(~inner, F.col("us"))).alias("end_us"),
        F.count_if(last).alias("has_last"),
    )

    # The row with the slice's last event stands last in its slice, so that the next slice's row follows it.
    chain = Window.partitionBy(*session).orderBy("slice", "has_last")
    interval = F.when(F.col("has_last") == 1, F.lead("first_us").over(chain) - F.col("end_us"))
    # A break separates what follows the slice: the events before it in the slice belong to the flow so far.
    so_far = Window.partitionBy(*site).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    part = "named_struct('flow_id', {}, 'us', {}, 'kept', {}, 'from_us', {})"
    head = part.format("before", "inner_us", "inner_count", "inner_from")
    tail = part.format(
        "before + breaks", "if(counts, interval, 0L)", "beside + if(counts, 1, 0)", "if(beside > 0 or counts, end_us, null)"
    )
    flows = (
        slices_of_sites.withColumn("interval", interval)
        .withColumn("counts", F.coalesce(F.col("interval") < F.lit(gap), F.lit(False)))
        .withColumn("breaks", F.coalesce(F.col("interval") > F.lit(gap), F.lit(False)).cast("long"))
        .withColumn("before", F.coalesce(F.sum("breaks").over(so_far), F.lit(0)))
        .select(*site, F.expr(f"explode(array({head}, {tail})) as part"))
        .select(*site, "part.*")
        .filter(F.col("kept") > 0)
        .groupBy(*site, "flow_id")
        .agg(
            (F.sum("us") / F.lit(1000.0) / F.sum("kept")).alias("avg_ms"),
            F.min("from_us").alias("from_us"),
            F.sum("kept").alias("event_count"),
        )
        .filter(F.col("event_count") > min_events)
    )
    start = minute_of_day(bin_in_day(F.col("from_us"), fixed_micros(width)))
    return (
        flows.groupBy(*users, start.alias("start"))
        .agg(
            F.pmod(F.avg("avg_ms"), F.lit(60_000.0)).alias("speed"),
            F.coalesce(F.stddev_samp(F.pmod("avg_ms", F.lit(60_000.0))), F.lit(0.0)).alias("volatility"),
            F.sum("event_count").alias("event_count"),
        )
        .select(
            *users,
            clock_label(hour_part(F.col("start")), minute_part(F.col("start")), padded).alias("time_bin"),
            "speed",
            "volatility",
            "event_count",
        )
        .orderBy("speed")
    )

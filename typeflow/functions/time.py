"""Time arithmetic.

Event times carry no zone (TIMESTAMP_NTZ). Inside the operators they are handled as whole microseconds since
1970-01-01, so gaps, windows and buckets are exact integer arithmetic. The conversion goes through the session
zone, so ``spark.sql.session.timeZone`` has to be UTC (``typeflow.session`` sets it); another zone is refused.

Reference instants (``as_of``) and text intervals ('6 hours', '1 month') are resolved on the driver, so every
cutoff enters the plan as a literal that reaches the parquet scan.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

EPOCH = datetime(1970, 1, 1)

_UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": SECOND,
    "minute": MINUTE,
    "hour": HOUR,
    "day": DAY,
    "week": 7 * DAY,
}
_UNIT_MONTHS = {"month": 1, "year": 12}
_SHORT = {"us": "microsecond", "ms": "millisecond", "sec": "second", "s": "second", "min": "minute", "m": "minute",
          "hr": "hour", "h": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "yr": "year"}
_CLOCK = re.compile(r"(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?$")
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")
_TERM = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([a-z]+?)s?(?=\s|\d|$)", re.IGNORECASE)


@dataclass(frozen=True)
class Span:
    """A length of time: whole months plus microseconds, as in SQL intervals."""

    months: int = 0
    micros: int = 0

    @property
    def fixed(self) -> bool:
        return self.months == 0


def span(value: str | timedelta | Span) -> Span:
    """Parse '15 minutes', '1 month', '1 hour 30 minutes', '90 min', '01:30:00', 'P1DT2H' and the like."""
    if isinstance(value, Span):
        return value
    if isinstance(value, timedelta):
        return Span(0, value // timedelta(microseconds=1))
    months, micros, at = 0, 0, 0
    text = value.strip()
    if clock := _CLOCK.match(text):
        hours, minutes, seconds = (float(x or 0) for x in clock.groups())
        return Span(0, round(hours * HOUR + minutes * MINUTE + seconds * SECOND))
    if (iso := _ISO.match(text)) and any(iso.groups()):
        years, more, weeks, days, hours, minutes, seconds = (float(x or 0) for x in iso.groups())
        length = (weeks * 7 + days) * DAY + hours * HOUR + minutes * MINUTE + seconds * SECOND
        return Span(int(years * 12 + more), round(length))
    while at < len(text):
        term = _TERM.match(text, at)
        if term is None:
            raise ValueError(f"not an interval: {value!r}")
        number, unit = term.group(1), term.group(2).lower()
        unit = _SHORT.get(unit, unit)
        if unit in _UNIT_MICROS:
            micros += round(float(number) * _UNIT_MICROS[unit])
        elif unit in _UNIT_MONTHS and "." not in number:
            months += int(number) * _UNIT_MONTHS[unit]
        else:
            raise ValueError(f"not an interval: {value!r}")
        at = term.end()
    if at == 0:
        raise ValueError("empty interval")
    return Span(months, micros)


def fixed_micros(value: str | timedelta | Span) -> int:
    """Microseconds of an interval that has no month part."""
    parsed = span(value)
    if not parsed.fixed:
        raise ValueError(f"interval must have a fixed length: {value!r}")
    return parsed.micros


def resolve(as_of: datetime | str | None) -> datetime:
    """The instant 'now' stands for: the given one, or the current UTC time without a zone."""
    if as_of is None:
        return datetime.now(timezone.utc).replace(tzinfo=None)
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def shift(moment: datetime, by: Span, sign: int = 1) -> datetime:
    """Add (or subtract) a span; month steps clamp to the last day of the month."""
    if by.months:
        index = moment.year * 12 + moment.month - 1 + sign * by.months
        year, month = divmod(index, 12)
        last = calendar.monthrange(year, month + 1)[1]
        moment = moment.replace(year=year, month=month + 1, day=min(moment.day, last))
    return moment + timedelta(microseconds=sign * by.micros)


def before(as_of: datetime | str | None, lookback: str | timedelta | Span) -> datetime:
    return shift(resolve(as_of), span(lookback), -1)


def since_now(lookback: str | timedelta | Span) -> Column:
    """The present time less ``lookback``, taken anew whenever the query runs."""
    by = span(lookback)
    return F.localtimestamp() - F.make_interval(
        months=F.lit(by.months), secs=(F.lit(by.micros) / F.lit(1e6)).cast("decimal(18,6)")
    )


def epoch_micros(moment: datetime) -> int:
    return (moment - EPOCH) // timedelta(microseconds=1)


def ntz(moment: datetime) -> Column:
    """Literal TIMESTAMP_NTZ."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") not in _UTC_NAMES:
        raise RuntimeError("set spark.sql.session.timeZone to UTC (typeflow.session.use_utc)")
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(us: Column, width: int, origin: int = 0) -> Column:
    """Largest ``origin + k * width`` not above ``us``."""
    return us - F.pmod(us - origin if origin else us, F.lit(width))


def day_of(us: Column) -> Column:
    """Midnight, in microseconds, of the day holding ``us``."""
    return floor_to(us, DAY)


def bin_in_day(us: Column, width: int) -> Column:
    """Start of the bucket holding ``us``; buckets restart at every midnight."""
    return us - F.pmod(F.pmod(us, F.lit(DAY)), F.lit(width))


def minute_of_day(us: Column) -> Column:
    return F.call_function("div", F.pmod(us, F.lit(DAY)), F.lit(MINUTE)).cast("int")


def hour_part(minute: Column) -> Column:
    return F.call_function("div", minute, F.lit(60)).cast("int")


def minute_part(minute: Column) -> Column:
    return F.pmod(minute, F.lit(60)).cast("int")


def milliseconds(us: Column, mode: str = "field") -> Column:
    """Milliseconds of a length in microseconds, as a double.

    ``field`` keeps only the seconds field (65.1 s counts as 5100 ms), ``elapsed`` the whole length.
    """
    return whole_micros(us, mode) / F.lit(1000.0)


def whole_micros(us: Column, mode: str = "field") -> Column:
    if mode not in ("field", "elapsed"):
        raise ValueError("mode must be 'field' or 'elapsed'")
    return F.pmod(us, F.lit(MINUTE)) if mode == "field" else us


# Weekday names, Sunday first.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def weekday_name(dow: Column, padded: bool = False, lower: bool = False) -> Column:
    """English weekday of a 0-based day number; ``padded`` blank-pads to nine characters."""
    names = [name.lower() if lower else name for name in WEEKDAYS]
    names = [name.ljust(9) if padded else name for name in names]
    return F.element_at(F.array(*[F.lit(name) for name in names]), (dow + F.lit(1)).cast("int"))

"""The composite queries as plain Python loops over collected rows: a yardstick of its own for small inputs.

Each returns a list of dicts. Times are datetimes, lengths timedeltas, None sorts first.
"""

from __future__ import annotations

import statistics
from collections import defaultdict
from datetime import datetime, timedelta


def length(text: str) -> timedelta:
    number, unit = text.split()
    unit = unit.rstrip("s") + "s"
    if unit == "months":
        return timedelta(days=31 * int(number))
    return timedelta(days=365 * int(number)) if unit == "years" else timedelta(**{unit: float(number)})


def rows_by(df, keys: list[str], time: str, order: str) -> dict[tuple, list]:
    """The rows of each key in time order."""
    groups = defaultdict(list)
    for row in df.collect():
        groups[tuple(row[k] for k in keys)].append(row)
    for rows in groups.values():
        rows.sort(key=lambda r: (r[time], r[order]))
    return groups


def split(rows: list, time: str, gap: timedelta) -> list[list]:
    """Runs of rows whose neighbours are at most ``gap`` apart."""
    runs: list[list] = []
    for row in rows:
        if runs and row[time] - runs[-1][-1][time] <= gap:
            runs[-1].append(row)
        else:
            runs.append([row])
    return runs


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def typing_speed(ev, as_of: datetime, lookback="6 hours", resolution="15 minutes", flow_gap="5 seconds") -> list[dict]:
    begin, step = as_of - length(lookback), length(resolution)
    windows = [begin + i * step for i in range((as_of - begin) // step + 1)]
    flows = defaultdict(list)
    kept = ev.filter(ev.record_time >= begin)
    for (user, *_), rows in rows_by(kept, ["user_id", "source_url", "session_id"], "record_time", "keystroke_id").items():
        placed = defaultdict(list)
        for row in rows:
            at = (row.record_time - begin) // step
            if at < len(windows):
                placed[at].append(row)
        for at, inside in placed.items():
            end = 0
            for run in split(inside, "record_time", length(flow_gap)):
                end += len(run)
                if len(run) < 2:
                    continue
                # The pause behind a flow counts as its last interval, of which only the seconds' field is taken.
                times = [r.record_time for r in inside[end - len(run) : end + 1]]
                ms = [micros(b - a) % 60_000_000 / 1000 for a, b in zip(times, times[1:])]
                flows[user, at].append((sum(ms) / len(ms), len(run), sum(bool(r.is_return) for r in run)))
    out = []
    for user in {user for user, _ in flows}:
        for at, start in enumerate(windows):
            if start < as_of:
                found = flows.get((user, at), [])
                n, wrong = sum(f[1] for f in found), sum(f[2] for f in found)
                out.append(
                    {
                        "user_id": user,
                        "window_start": start,
                        "speed": sum(f[0] * f[1] for f in found) / n if n else None,
                        "volatility": statistics.stdev([f[0] for f in found]) if len(found) > 1 else 0.0,
                        "event_count": n,
                        "error_count": wrong,
                        "relative_error": wrong / n if n else 0.0,
                    }
                )
    return out


def session_times(ev, as_of: datetime, lookback="1 month", gap="3 minutes") -> list[dict]:
    begin = as_of.replace(month=as_of.month - 1) if lookback == "1 month" else as_of - length(lookback)
    days = defaultdict(list)
    for (user,), rows in rows_by(ev.filter(ev.record_time > begin), ["user_id"], "record_time", "keystroke_id").items():
        runs = split(rows, "record_time", length(gap))
        for i, run in enumerate(runs):
            first, last = (run[0].record_time if i else None), run[-1].record_time
            if i + 1 < len(runs):
                days[user, runs[i + 1][0].record_time.date()].append((first, last))
            elif as_of - last < length(gap) and len(rows) > 1 and len(run) > 1:
                days[user, last.date()].append((first, run[-2].record_time))
            elif as_of - last < length(gap) and len(rows) == 1:
                days[user, last.date()].append((None, None))
    out = []
    for (user, day), found in days.items():
        minutes = [micros(b - a) / 6e7 for a, b in found if a is not None]
        out.append(
            {
                "user_id": user,
                "session_date": day,
                "total_minutes": sum(minutes),
                "number_of_sessions": len(found),
                "median_session_duration": statistics.median(minutes) if minutes else 0.0,
                "sessions_end": max((b for _, b in found if b is not None), default=None),
            }
        )
    return out


def speed_by_time_of_day(ev, as_of: datetime, lookback="3 days", flow_gap="5 seconds", min_events=5) -> list[dict]:
    gap, bins = length(flow_gap), defaultdict(list)
    kept = ev.filter(ev.record_time > as_of - length(lookback))
    for (_,), rows in rows_by(kept, ["session_id"], "record_time", "keystroke_id").items():
        after = {a.keystroke_id: b.record_time - a.record_time for a, b in zip(rows, rows[1:])}
        for url in {r.source_url for r in rows}:
            site = [r for r in rows if r.source_url == url]
            pauses = [r.record_time for r in site if after.get(r.keystroke_id, timedelta(0)) > gap]
            flows = defaultdict(list)
            for row in site:
                if row.keystroke_id in after and after[row.keystroke_id] < gap:
                    flows[sum(p <= row.record_time for p in pauses)].append(row)
            for flow in flows.values():
                if len(flow) > min_events:
                    ms = sum(micros(after[r.keystroke_id]) for r in flow) / len(flow) / 1000
                    at = min(r.record_time for r in flow)
                    bins[f"{at.hour}:{at.minute // 15 * 15}"].append((ms, len(flow)))
    return [
        {
            "time_bin": label,
            "speed": statistics.fmean(f[0] for f in found),
            "volatility": statistics.stdev([f[0] for f in found]) if len(found) > 1 else 0.0,
            "event_count": sum(f[1] for f in found),
        }
        for label, found in bins.items()
    ]


def sessions(kev, gap: str, by_app: bool) -> list[dict]:
    out = []
    for key, rows in rows_by(kev, ["App"] if by_app else [], "Timestamp", "event_id").items():
        for number, run in enumerate(split(rows, "Timestamp", length(gap)), 1):
            days = defaultdict(list)
            for row in run:
                days[row.Timestamp.date()].append(row.Timestamp)
            for day, times in days.items():
                if times[-1] > times[0]:
                    found = {"session_date": day, "session_number": number, "session_start": times[0], "session_end": times[-1]}
                    out.append(found | ({"App": key[0]} if by_app else {}))
    return out


def time_of_day_dense(ev) -> list[dict]:
    counts = defaultdict(int)
    for row in ev.collect():
        t = row.record_time
        counts[t.date(), t.hour, t.minute // 15 * 15] += 1
    if not counts:
        return []
    first, last = min(d for d, *_ in counts), max(d for d, *_ in counts)
    whole = [first + timedelta(days=i) for i in range((last - first).days)]
    out = []
    for hour in range(24):
        for minute in (0, 15, 30, 45):
            # The last day takes part with its first quarter of an hour only.
            days = whole + [last] if (hour, minute) == (0, 0) else whole
            if days:
                mean = sum(counts.get((d, hour, minute), 0) for d in days) / len(days)
                out.append({"hour": hour, "minute": minute, "strokes_count": mean})
    return out


def inter_key_interval(kev, keys: list[str]) -> list[dict]:
    out = []
    for rows in rows_by(kev, keys, "Timestamp", "event_id").values():
        before = None
        for row in rows:
            gap = None if before is None else micros(row.Timestamp - before)
            out.append({"event_id": row.event_id, "App": row.App, "interval_us": gap})
            before = row.Timestamp
    return out

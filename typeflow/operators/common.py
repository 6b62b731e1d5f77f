"""Filters and joins shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.functions.time import Span, before, ntz

# Written tables are partitioned by this date column (see typeflow.sources.events).
DATE_PARTITION = "event_date"


def starting(df: DataFrame, ts: str, cutoff: datetime, inclusive: bool = False) -> DataFrame:
    """Rows after a cutoff; on date-partitioned tables whole partitions are skipped too."""
    if DATE_PARTITION in df.columns:
        df = df.filter(F.col(DATE_PARTITION) >= F.lit(cutoff.date()))
    bound = ntz(cutoff)
    return df.filter(F.col(ts) >= bound if inclusive else F.col(ts) > bound)


def looking_back(
    df: DataFrame,
    as_of: datetime | str | None,
    lookback: str | timedelta | Span | None,
    user: str | None = None,
    ts: str = "record_time",
    inclusive: bool = False,
) -> DataFrame:
    """Events of the last ``lookback`` before ``as_of`` (``None``: the whole history), of one user or of all."""
    if lookback is not None:
        df = starting(df, ts, before(as_of, lookback), inclusive)
    return of_user(df, user)


def of_user(df: DataFrame, user: str | None) -> DataFrame:
    return df if user is None else df.filter(F.col("user_id") == F.lit(user))


def join_same(
    left: DataFrame, right: DataFrame, keys: Sequence[str], first: str | None = None, how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns of the left side stay.

    A null-safe join also adds no IS NOT NULL filter to one side, so where both sides come from the same shuffle
    they stay alike and the shuffle is done once. ``first`` names a selective key without NULLs to sort by first.
    """
    names = list(keys) if first is None else [first, *keys]
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    same = [left[first] == renamed[f"_r_{first}"]] if first is not None else []
    same += [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{name}" for name in names])

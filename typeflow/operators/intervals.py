"""Gap of every event to the one before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeflow.functions.time import DAY, fixed_micros, floor_to, micros


def _carried(cut: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """For each key and stretch the last moment before the stretch, as ``us``.

    Stretches of a day are ordered among themselves; the first one of a day takes the last moment of the days before,
    from a table of one row per key and day. So no task orders a key's whole history of stretches.
    """
    last = (
        cut.filter("us is not null")
        .groupBy(*keys, "stretch")
        .agg(F.max("us").alias("last_us"))
        .withColumn("day", floor_to(F.col("stretch"), max(DAY, stretch)))
    )
    in_day = Window.partitionBy(*keys, "day").orderBy("stretch")
    over_days = Window.partitionBy(*keys).orderBy("day")
    inside = last.withColumn("us", F.lag("last_us").over(in_day)).select(*keys, "stretch", "us")
    first = last.groupBy(*keys, "day").agg(F.max("last_us").alias("last_us"), F.min("stretch").alias("stretch"))
    across = first.withColumn("us", F.lag("last_us").over(over_days)).select(*keys, "stretch", "us")
    return inside.unionByName(across).filter("us is not null")


def inter_key_interval(
    kev: DataFrame, keys: Sequence[str] = (), id_column: str = "event_id", stretch="10 minutes"
) -> DataFrame:
    """Events with ``interval_us``, the microseconds since the key's previous event; NULL for its first.

    Among events of one moment the one with the lowest id carries the gap and the others have 0. History is cut into
    stretches that are sorted apart, after one exchange of the events; each stretch also receives the last moment
    before it, so that its first event finds it by ``lag``. Events without a time have no interval and are spread out.
    """
    keys, width = list(keys), fixed_micros(stretch)
    nowhere = -F.pmod(F.xxhash64(id_column), F.lit(1024)) - (1 << 62)
    events = kev.withColumn("us", micros("Timestamp"))
    cut = events.withColumn("stretch", F.coalesce(floor_to(F.col("us"), width), nowhere))
    carried = _carried(cut, keys, width).withColumn("carried", F.lit(1))
    inside = Window.partitionBy(*keys, "stretch").orderBy("us", F.desc("carried"), id_column)
    return (
        cut.withColumn("carried", F.lit(0))
        .unionByName(carried, allowMissingColumns=True)
        .withColumn("interval_us", (F.col("us") - F.lag("us").over(inside)).cast("long"))
        .filter("carried = 0")
        .drop("us", "stretch", "carried")
    )

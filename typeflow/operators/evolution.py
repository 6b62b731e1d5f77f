"""Schema changes of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_tags(ev: DataFrame, name: str = "tags") -> DataFrame:
    """A nullable array-of-text column; tables that have it stay as they are."""
    if name in ev.columns:
        return ev
    return ev.withColumn(name, F.lit(None).cast("array<string>"))

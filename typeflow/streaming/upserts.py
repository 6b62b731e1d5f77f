"""Results of a running stream as a table of newest rows per key.

A stream in update mode gives, per micro-batch, the rows that changed. Each batch is one folder, named by its number and
overwritten when the batch is repeated, so a batch counts once however often it runs. Whenever ``EVERY`` batches are
there they are merged into one folder, ``EVERY`` of these into a larger one and so on: every row is rewritten once for
each power of ``EVERY``, and the number of folders grows with the logarithm of the batches. A folder counts only once it
is complete; merged ones go away at a later merge, so that whoever was reading them can finish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from typeflow.session import exists, folders, remove

EVERY = 8
ONCE = {"availableNow": True}
VERSION = "_batch"


def _name(first: int, last: int) -> str:
    return f"run-{first:012d}-{last:012d}"


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last batch of every complete folder."""
    named = [name.split("-") for name in folders(spark, path) if name.startswith("run-")]
    found = [(int(first), int(last)) for _, first, last in named]
    return [run for run in found if exists(spark, f"{path}/{_name(*run)}/_SUCCESS")]


def _within(run: tuple[int, int], other: tuple[int, int]) -> bool:
    return run != other and other[0] <= run[0] and run[1] <= other[1]


def _read(spark: SparkSession, path: str, chosen: Sequence[tuple[int, int]], schema: StructType) -> DataFrame:
    stored = StructType([*schema.fields, StructField(VERSION, LongType())])
    if not chosen:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(*[f"{path}/{_name(*run)}" for run in chosen])


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [name for name in rows.columns if name not in (*keys, VERSION)]
    last = F.max_by(F.struct(*others, VERSION), VERSION).alias("last")
    newest = rows.groupBy(*keys).agg(last).filter("last is not null")
    return newest.select(*[F.col(name) if name in keys else F.col(f"last.`{name}`").alias(name) for name in rows.columns])


def put(batch: DataFrame, number: int, path: str, keys: Sequence[str]) -> None:
    """Stores a batch's rows, one for each key at most, and merges what is due."""
    spark, schema = batch.sparkSession, batch.schema
    batch.withColumn(VERSION, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{_name(number, number)}")
    size = EVERY
    while (number + 1) % size == 0:
        merged = (number + 1 - size, number)
        known = runs(spark, path)
        parts = [run for run in known if _within(run, merged) and run[1] - run[0] + 1 == size // EVERY]
        rows = _newest(_read(spark, path, parts, schema), keys)
        rows.write.mode("overwrite").parquet(f"{path}/{_name(*merged)}")
        for run in known:
            if any(_within(run, other) and other[1] < number for other in known):
                remove(spark, f"{path}/{_name(*run)}")
        size *= EVERY


def latest(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key, of all batches that are complete."""
    known = runs(spark, path)
    chosen = [run for run in known if not any(_within(run, other) for other in known)]
    return _newest(_read(spark, path, chosen, schema), keys).drop(VERSION)


def start_upserts(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], trigger: dict = ONCE, mode: str = "update"
) -> StreamingQuery:
    """Keeps the changed rows of a live table below ``path``; one path belongs to one checkpoint."""
    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, number: put(batch, number, path, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )

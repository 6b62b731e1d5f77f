"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

First pass: every record goes to a bucket named by a seeded hash, so that buckets are small enough for a task's memory.
Second pass: each bucket is shuffled in memory (Spark's ``shuffle`` of an array is Fisher-Yates) and its records take
the next places of one global order. The order is cut into shards whose counts are at most one apart (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.llm.common import saved

SHARDS = 40
SEED = 17
#: Bytes of text that one bucket holds on average.
BUCKET_BYTES = 8 << 20
#: What a record counts besides its text.
RECORD_BYTES = 16
#: Buckets whose counts are added up together.
GROUP = 4096


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_BYTES


def scattered(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """First pass: the records (column ``record``) with the ``bucket`` that a seeded hash gives them.

    The hash is over the key, the text and a row number drawn in each task, so that rows repeated any number of times
    and null keys spread as well as any others.
    """
    at = F.monotonically_increasing_id()
    draw = F.xxhash64(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))), at, F.lit(seed))
    return docs.select(
        F.struct(*docs.columns).alias("record"), draw.alias("draw"), F.pmod(draw, F.lit(buckets)).alias("bucket")
    )


def starts(sizes: DataFrame) -> DataFrame:
    """Where each ``bucket`` begins in the global order: sums over groups of buckets, then inside each group."""
    sizes = sizes.withColumn("group", F.expr(f"bucket div {GROUP}"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(groups, "group").select("bucket", (F.col("first") + F.col("own")).alias("first"))


def shuffled(rows: DataFrame, firsts: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Second pass: each bucket in a random order, its records (``record``) at the global ``place`` they got.

    Buckets come into tasks by one exchange; where they begin is joined to whole buckets, not to records.
    """
    dealt = rows.repartition(buckets, "bucket")
    grouped = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("draw", "record"))).alias("rows"))
    mixed = grouped.join(firsts, "bucket").sortWithinPartitions("bucket")
    mixed = mixed.withColumn("rows", F.shuffle("rows", F.lit(seed)))
    return mixed.select("first", F.posexplode("rows").alias("at", "row")).select(
        (F.col("first") + F.col("at")).alias("place"), "row.record"
    )


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` (0 to ``count`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``docs`` needs ``doc_id`` and ``text``; all its columns come back. Null texts count as nothing besides the record's
    own bytes; null keys and repeated rows are placed like others; an empty table gives none. Own columns named
    ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    volume = docs.agg(F.sum(record_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-volume // bucket_bytes))
    rows = saved(scattered(docs, buckets, seed), "scattered")
    sizes = saved(rows.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0

    # Place p belongs to shard floor(p * count / total); a shard begins at ceil(shard * total / count).
    placed = shuffled(rows, starts(sizes), buckets, seed)
    placed = placed.withColumn("shard", F.expr(f"int(place * {count} div {max(total, 1)})"))
    slot = F.expr(f"place - (bigint(shard) * {total} + {count - 1}) div {count}")
    return placed.withColumn("slot", slot).select("record.*", "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes a folder per shard, its rows in the order of their slots, cut into files only where a shard is large."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

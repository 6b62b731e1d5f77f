"""Key events as CSV drops."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeflow.schema import KEY_EVENTS

_CORRUPT = "_corrupt_record"
_TEXT_SCHEMA = T.StructType(
    [*[T.StructField(name, T.StringType()) for name in KEY_EVENTS.names], T.StructField(_CORRUPT, T.StringType())]
)


_OPTIONS = {"escape": '"', "columnNameOfCorruptRecord": _CORRUPT}

# What one task makes of a block: whole records, and pieces of those that reach over its ends.
_PIECES = "file string, block bigint, piece int, value string"
_HEAD, _TAIL = 1, 2


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The lines of each block in a batch."""
    file, block = batch.column("file"), batch.column("block").to_numpy()
    changes = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(block)]
    for start, end in zip(bounds, bounds[1:]):
        if start < end:
            yield batch.slice(start, end - start)


def _assembled(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[pa.RecordBatch]:
    """Whole records of the blocks in a partition (``value``), or else the pieces; lines come in file order.

    ``inside`` says whether a block begins inside quotes, ``odd`` whether a line has an odd number of them. A line is a
    record of its own, unless quotes are open before or after it. The header of a file, its first line, is left out.
    """
    at, opened, pending, headless, found = None, False, [], False, []

    def closing() -> None:
        """Notes the piece left when a block ends with quotes open."""
        if pending and pieces:
            found.append((*at, _HEAD if headless else _TAIL, "\n".join(pending)))

    def taken() -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        found.clear()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "piece", "value"])

    for batch in batches:
        for lines in _blocks(batch):
            here = lines.column("file")[0].as_py(), lines.column("block")[0].as_py()
            values, odd = lines.column("value"), lines.column("odd").to_numpy(zero_copy_only=False)
            if here != at:
                closing()
                at, pending, opened = here, [], lines.column("inside")[0].as_py()
                headless = opened
                if here[1] == 0:
                    values, odd = values[1:], odd[1:]
            after = np.logical_xor.accumulate(np.concatenate([[opened], odd]))[1:]
            opened = bool(after[-1]) if len(after) else opened
            ends = np.flatnonzero(~after) + 1  # a record ends with each line that leaves no quotes open
            if len(ends) and (pending or headless):
                first = "\n".join([*pending, *values[: ends[0]].to_pylist()])
                if headless and pieces:
                    found.append((*here, _HEAD, first))
                elif not headless and not pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.string())], names=["value"])
                pending, headless, values, ends = [], False, values[ends[0] :], ends[1:] - ends[0]
            if len(ends) and not pieces:
                records = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values[: ends[-1]])
                yield pa.RecordBatch.from_arrays([pc.binary_join(records, "\n")], names=["value"])
            pending += values[ends[-1] if len(ends) else 0 :].to_pylist()
        if pieces:
            yield taken()
    closing()
    if pieces:
        yield taken()


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The text of every record (``value``), in which quoted line breaks stay, read by as many tasks as there are blocks.

    Whether a block begins inside quotes follows from the quotes of the blocks before it in its file, counted in a
    first pass: one row for each block. Only records that reach over a block's end are shuffled, as pieces; blocks
    without any aren't read for them, and where no block has one, no pass is made.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        (F.pmod(quotes, F.lit(2)) == 1).alias("odd"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.count_if("odd").alias("odd"))
        .withColumn("before", F.coalesce(F.sum("odd").over(before), F.lit(0)))
        .select(
            "file",
            "block",
            (F.pmod("before", F.lit(2)) == 1).alias("inside"),
            (F.pmod(F.col("before") + F.col("odd"), F.lit(2)) == 1).alias("open"),
        )
    )
    # The driver plans one split for each block, so a row for each is no more than it holds already. The lines must
    # stay where they are, in order.
    placed = lambda some: lines.join(F.broadcast(some.drop("open")), ["file", "block"])
    whole = placed(blocks).mapInArrow(partial(_assembled, pieces=False), "value string")
    found = placed(blocks.filter("inside or open")).mapInArrow(partial(_assembled, pieces=True), _PIECES)
    in_file = Window.partitionBy("file").orderBy("block", "piece")
    joined = (
        found.withColumn("record", F.sum((F.col("piece") == _TAIL).cast("int")).over(in_file))
        .groupBy("file", "record")
        .agg(F.sort_array(F.collect_list(F.struct("block", "piece", "value"))).alias("pieces"))
        .select(F.array_join("pieces.value", "\n").alias("value"))
    )
    plain = F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    return whole.unionByName(joined).select(plain.alias("value")).filter("value <> ''")


def read_key_csv(spark: SparkSession, path: str, zone: str = "UTC", split: bool = True) -> DataFrame:
    """All CSV files below ``path``, times in the report zone; rows that do not fit the schema are skipped: a row of
    another length, or one with a cell that can't be read as its column's type. An empty cell is NULL and fits.

    Every column is read as text and cast here, whatever a later query selects: a row's fate must not depend on
    which columns are asked for. Quoted fields may hold doubled quotes, commas and line breaks. Files are read block by
    block, a large one by many tasks, a gzip file by one; this needs quotes that come in pairs, as CSV has them. With
    ``split=False`` each file is read by one task, and a lone quote inside an unquoted cell is part of it.
    """
    if split:
        parsed = F.from_csv("value", ", ".join(f"{name} string" for name in _TEXT_SCHEMA.names), _OPTIONS)
        # Not row.*: filters on its fields would move below it and parse a record once for each of them.
        text = _records(spark, path).select(F.inline_outer(F.array(parsed)))
    else:
        reader = spark.read.schema(_TEXT_SCHEMA).options(**_OPTIONS)
        text = reader.option("header", True).option("multiLine", True).option("columnPruning", False).csv(path)
    cast = {field.name: F.col(field.name).try_cast(field.dataType) for field in KEY_EVENTS.fields}
    moment = F.col("Timestamp").try_cast("timestamp").cast("timestamp_ntz")
    cast["Timestamp"] = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment) if zone != "UTC" else moment
    fits = F.col(_CORRUPT).isNull()
    for name in ("Timestamp", "Interval_ns", "SeqNum"):
        fits = fits & (F.col(name).isNull() | cast[name].isNotNull())
    return text.filter(fits).select(*[cast[name].alias(name) for name in KEY_EVENTS.names])


def key_preview(kev: DataFrame, n: int = 10) -> DataFrame:
    """Sequence number and app of a few rows."""
    return kev.select("SeqNum", "App").limit(n)


def write_key_csv(
    kev: DataFrame, path: str, rows_per_file: int | None = None, zone: str = "UTC", compressed: bool = False
) -> None:
    """CSV drops with header; times of ``zone`` as ISO-8601 in UTC, quotes doubled, defaults for missing app and title.

    With ``compressed`` they are gzip files, each of which is read by one task: give ``rows_per_file`` too.
    """
    moment = F.convert_timezone(F.lit(zone), F.lit("UTC"), "Timestamp") if zone != "UTC" else F.col("Timestamp")
    rows = kev.select(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("Timestamp"),
        "Interval_ns",
        "SeqNum",
        F.coalesce("App", F.lit("Unknown")).alias("App"),
        F.coalesce("Title", F.lit("Untitled")).alias("Title"),
        "Category",
    )
    writer = (
        rows.write.mode("append")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if compressed:
        # Level four: on texts a few hundredths larger than the default's files, in less than half its time.
        writer = writer.option("compression", "gzip").option("zlib.compress.level", "FOUR")
    writer.csv(path)

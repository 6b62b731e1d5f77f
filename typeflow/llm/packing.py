"""Packing of token sequences into windows by best-fit decreasing.

A document becomes its token ids and an end id. Documents longer than a window are first cut into full windows; what is
left of them, and every shorter document, is an item of some length below the window. Best-fit decreasing looks at
nothing but lengths, and there are at most ``window`` of them: the driver packs the histogram of lengths (a table of at
most ``window`` rows, whatever the size of the corpus), handling all equal items against all equally filled windows in
one step, and Spark then places every item by its rank among the items of its length.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeflow.llm.common import importable, saved

WINDOW = 2048
END_ID = 1
#: Items of one length that are numbered together.
CHUNK_ROWS = 500


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a byte-level vocabulary file, and the end id behind them.

    The ids are those the ``tokenizers`` library gives for the file (the tests compare them), a special token's string in
    a text being that token; tiktoken makes them from the file's ranks in a third of the time.
    """

    #: Splits text before the merges, as the file's byte-level pre-tokenizer does.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str, end_id: int):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        of = _byte_alphabet()
        ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._end = np.array([end_id], dtype=np.uint32)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return self._end
        return np.concatenate([self._encoding.encode_to_numpy(text, allowed_special="all"), self._end])


@functools.lru_cache(4)
def encoder(vocabulary: str, end_id: int = END_ID) -> Encoder:
    return Encoder(vocabulary, end_id)


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces of every document: its full windows and what is left, with checksums, and the ids if asked for.

    ``docs`` needs ``doc_id`` and ``text``; a null text counts as empty (its only id is ``end_id``), a null doc_id is
    kept, repeated rows each have their pieces, further columns are left out.
    """
    importable(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, end_id).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py())
                total = len(tokens)
                for start in range(0, total, window):
                    piece = tokens[start : start + window].astype("<u4").tobytes()
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, piece))
            columns = list(zip(*rows)) if rows else [()] * 6
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())] * ids
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


class RemainingTree:
    """A segment tree over remaining capacities: which of them, at least ``size``, is the smallest with open windows."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, windows: int) -> None:
        node = remaining + self.leaves
        while node:
            self.open[node] += windows
            node >>= 1

    def tightest(self, size: int) -> int | None:
        node = size + self.leaves
        if self.open[node]:
            return size
        while node > 1 and not (node % 2 == 0 and self.open[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Packs ``histogram[length]`` items of each length; gives steps (length, first rank, items, first sequence, items
    for a sequence, first offset).

    The items of a step, by rank, fill sequences one after the other. Equal items go together: with the tightest open
    window that fits, the next equal item finds that same window tightest as long as it still fits.
    """
    tree = RemainingTree(window)
    ranges: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first sequence, sequences)
    steps, fresh = [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            ranges.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = window
                first, count = fresh, -(-left // (window // length))
                fresh += count
            else:
                first, count = ranges[remaining].pop()
                tree.add(remaining, -count)
            fit = remaining // length
            used = min(count, -(-left // fit))
            items = min(left, used * fit)
            steps.append((length, rank, items, first, fit, window - remaining))
            full, last = divmod(items, fit)
            put(remaining - fit * length, first, full)
            if last:
                put(remaining - last * length, first + full, 1)
            put(remaining, first + used, count - used)
            rank, left = rank + items, left - items
    return steps


def ranked(items: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Numbers the items of each length from 0, as ``rank``, without bringing those of one length into one task."""
    counts = [(length, -(-n // CHUNK_ROWS)) for length, n in histogram.items()]
    chunks = items.sparkSession.createDataFrame(counts, "length bigint, _chunks bigint")
    items = items.join(F.broadcast(chunks), "length")  # a row for each length, at most ``window``
    items = items.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "_chunks")).drop("_chunks")
    sizes = items.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = items.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "_chunk"]).withColumn("rank", F.col("_first") + F.col("_at")).drop(
        "_chunk", "_first", "_at"
    )


def packed(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Gives each piece its ``sequence_id`` and ``offset``. ``parts`` is read three times: a stored table.

    No sequence is longer than ``window``; offsets have no gaps; sequences are numbered from 0 without gaps. An empty
    table stays empty. Repeated pieces are packed each for itself.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``window`` rows
    steps = best_fit_decreasing(histogram, window)
    plan = np.array(steps, dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)  # a few rows for each length
    items = ranked(parts, histogram)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        span = np.int64(1) << 40
        starts = steps[:, 0] * span + steps[:, 1]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = table["length"].to_numpy()
            rank = table["rank"].to_numpy()
            step = steps[np.searchsorted(starts, length * span + rank, side="right") - 1]
            at = rank - step[:, 1]
            table = table.drop_columns(["rank"])
            table = table.append_column("sequence_id", pa.array(step[:, 3] + at // step[:, 4]))
            table = table.append_column("offset", pa.array(step[:, 5] + at % step[:, 4] * length))
            yield from table.to_batches()

    columns = [c for c in items.columns if c != "rank"]
    schema = ", ".join(f"{c} {dict(items.dtypes)[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    return items.select(*columns, "rank").mapInArrow(place, schema)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Tokenizes and packs ``docs``: one row per piece with ``sequence_id`` and ``offset`` (see :func:`pieces`)."""
    return packed(saved(pieces(docs, vocabulary, window, end_id, ids), "pieces"), window)


def sequences(placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The filled sequences of pieces placed with their ids: ``sequence_id``, ``ids`` (bytes), ``padding`` (tokens).

    Each sequence is padded to ``window``, except where its length is a power of two.
    """
    pad = np.array([pad_id], dtype="<u4").tobytes().hex()
    parts = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("_used")
    )
    padding = F.when(F.bit_count(F.col("_used")) == 1, 0).otherwise(window - F.col("_used"))
    filled = F.aggregate("_parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    return parts.withColumn("padding", padding.cast("bigint")).select(
        "sequence_id", F.concat(filled, F.expr(f"unhex(repeat('{pad}', int(padding)))")).alias("ids"), "padding"
    )

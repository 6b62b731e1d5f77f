"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by 1 + ln(how often it occurs). For each of ``SAMPLES`` positions every word draws
r and c from Gamma(2, 1) and b from [0, 1), all following from the word and the position alone. With
t = floor(ln(weight) / r + b), the word with the smallest ln c - r (t - b) - r is sampled, together with its t. Two
texts sample the same at a position with a probability equal to the generalised Jaccard similarity of their weights,
the sum of the smaller weights over the sum of the larger ones. A fingerprint is 16 bits of each sample, as hex.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import importable, parallelism

SAMPLES = 128
#: Words whose draws a worker keeps before it starts anew, as they stand in texts once and more than once; it changes
#: speed only.
CACHE, CACHE_MORE = 1 << 18, 1 << 14
#: Ranges of doc_id for each shuffle partition.
RANGES = 8
UNNAMED = 1 << 62

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Sampler:
    """Fingerprints of texts; keeps the draws of words it has seen."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self._rows: dict[str, int] = {}
        self._hash = np.empty(CACHE, np.uint64)
        self._once = np.empty((CACHE, samples), np.float32)
        self._more_rows: dict[str, int] = {}
        self._r, self._ln_c, self._b = (np.empty((CACHE_MORE, samples), np.float32) for _ in range(3))
        self._position = _mixed(np.arange(1, samples + 1, dtype=np.uint64) * _STEP)

    def _drawn(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Hashes of words, and their draws."""
        import xxhash

        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        seed = h[:, None] ^ self._position

        def uniforms(i: int) -> list[np.ndarray]:
            """Three from each 64 bits."""
            bits = _mixed(seed + np.uint64(i * int(_STEP) % (1 << 64)))
            low = [(bits >> np.uint64(k)) & np.uint64((1 << 21) - 1) for k in (0, 21, 42)]
            return [(x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21) for x in low]

        (a, b, beta), (c, d, _) = uniforms(1), uniforms(2)
        return h, -np.log(a * b), np.log(-np.log(c * d)), beta

    @staticmethod
    def _places(kept: dict[str, int], most: int, words: list[str]) -> tuple[np.ndarray, list[str], slice]:
        """Where ``words`` stand, ``most`` at a time; which of them are new, and the rows that these get."""
        new = [w for w in words if w not in kept]
        if len(kept) + len(new) > most:
            kept.clear()
            new = words
        rows = slice(len(kept), len(kept) + len(new))
        kept.update(zip(new, range(rows.start, rows.stop)))
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words)), new, rows

    def _rows_of(self, words: list[str]) -> np.ndarray:
        at, new, rows = self._places(self._rows, CACHE, words)
        if new:
            self._hash[rows], r, ln_c, beta = self._drawn(new)
            self._once[rows] = ln_c + r * beta - r
        return at

    def _more_of(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The draws themselves, for words that a text has more than once."""
        found = []
        for start in range(0, len(words), CACHE_MORE):
            at, new, rows = self._places(self._more_rows, CACHE_MORE, words[start : start + CACHE_MORE])
            if new:
                _, self._r[rows], self._ln_c[rows], self._b[rows] = self._drawn(new)
            found.append((self._r[at], self._ln_c[at], self._b[at]))
        return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]

    def __call__(self, text: str) -> np.ndarray:
        """16 bits of every sample; zeros for a text without words."""
        counts = Counter(text.lower().split())
        if not counts:
            return np.zeros(self.samples, np.uint16)
        best, at, t_at = None, None, None
        words = list(counts)
        for start in range(0, len(words), CACHE // 2):  # a text may have more words than are kept
            part = words[start : start + CACHE // 2]
            rows = self._rows_of(part)
            n = np.fromiter(map(counts.__getitem__, part), np.int64, len(part))
            value = self._once[rows]
            more = np.flatnonzero(n > 1)
            t = None
            if len(more):
                r, ln_c, b = self._more_of([part[i] for i in more.tolist()])
                ln_w = np.log(1 + np.log(n[more])).astype(np.float32)[:, None]
                t = np.floor(ln_w / r + b)
                value[more] = ln_c - r * (t - b) - r
            found = value.argmin(axis=0)
            least = value[found, np.arange(self.samples)]
            steps = np.zeros(self.samples, np.int64)
            if t is not None:
                place = np.full(len(part), -1)
                place[more] = np.arange(len(more))
                often = place[found]
                steps = np.where(often >= 0, t[often, np.arange(self.samples)], 0).astype(np.int64)
            code = self._hash[rows[found]]
            if best is None:
                best, at, t_at = least, code, steps
            else:
                closer = least < best
                best, at, t_at = np.where(closer, least, best), np.where(closer, code, at), np.where(closer, steps, t_at)
        bits = _mixed(at ^ self._position ^ (t_at.astype(np.uint64) * _STEP)) >> np.uint64(48)
        return np.maximum(bits, 1).astype(np.uint16)  # zero is for texts without words


@functools.lru_cache(1)
def sampler(samples: int = SAMPLES) -> Sampler:
    """Kept by a worker from task to task."""
    return Sampler(samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many characters, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows ordered inside ranges of doc_id, such that each row's successor follows it: ``bucket``, ``extra``, ``doc_id``,
    ``text``. The first row of each range also stands, as ``extra``, at the end of the range before, and the first
    row of all at the end of the last one.

    Ranges are cut at quantiles, a few for each shuffle partition, so texts are moved once and no task orders all rows.
    """
    spark = docs.sparkSession
    unnamed = F.pmod(F.xxhash64("text"), F.lit(1 << 60)) + F.lit(UNNAMED)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", unnamed))
    wanted = RANGES * parallelism(spark)
    cuts = rows.select(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0]
    shared = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), side="left").astype(np.int32))

    firsts = rows.select("key").groupBy(bucket("key").alias("bucket")).agg(F.min("key").alias("key")).collect()
    order = sorted((r.bucket, r.key) for r in firsts)  # a number for each range
    before = {key: order[i - 1][0] for i, (_, key) in enumerate(order)}
    doubled = spark.sparkContext.broadcast(before)

    @F.pandas_udf("array<int>")
    def buckets(key: pd.Series) -> pd.Series:
        own = np.searchsorted(shared.value, key.to_numpy(), side="left").tolist()
        also = map(doubled.value.get, key.tolist())
        return pd.Series([[a] if b is None else [a, b] for a, b in zip(own, also)])

    moved = rows.select("doc_id", "key", "text", F.posexplode(buckets("key")).alias("extra", "bucket"))
    moved = moved.withColumn("hash", F.xxhash64("text"))
    ordered = moved.repartition("bucket").sortWithinPartitions("bucket", "extra", "key", "hash")
    return ordered.select("bucket", "extra", "doc_id", "text")


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every row's fingerprint, that of its text edited with its successor's, and how alike they are.

    Columns: ``doc_id``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``, the shares of equal samples. The successor is the next row by doc_id, of one doc_id by a hash
    of the text, rows without a doc_id last; a single row is its own. Null texts are empty, texts without words have a fingerprint
    of zeros; texts are read whole; further columns are left out.
    """
    importable(docs.sparkSession)
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, last = sampler(samples), None
        for batch in batches:
            out: list[tuple] = []
            for i in range(len(batch)):
                bucket, extra, doc, text = (batch.column(c)[i].as_py() for c in range(4))
                own = sample(text)
                if last is not None and last[0] == bucket and not last[1]:
                    _, _, before, there, found = last
                    edited = edited_text(there, text)
                    other = sample(edited)
                    out.append(
                        (
                            before,
                            len(there),
                            hashlib.sha256(edited.encode()).hexdigest(),
                            found.astype(">u2").tobytes().hex(),
                            other.astype(">u2").tobytes().hex(),
                            likeness(found, other),
                            likeness(found, own),
                        )
                    )
                last = (bucket, extra, doc, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return with_successors(docs).mapInArrow(look, schema)

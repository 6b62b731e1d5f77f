"""Exact Jaccard join of documents as sets of word n-grams.

Candidates come from an exact filter. Two sets of sizes a and b that reach the threshold differ in few members, at most
``limit(a + b)``. Hash space is cut into parts, the same for all sets of a size band; if a set shows its first
``limit + 1`` parts that aren't empty, one of them is untouched by any difference, so both sets show the same part
with the same members. Sets that share a part are joined into clusters.

Members that a fixed share of all documents have (a license line, a passage) would join sets that aren't alike. Leaving
the same members out of both sets removes differences only, so parts are made of the rarer members alone wherever these
make up half of a set; sets that have fewer, and all that might be linked to one, show parts of all their members
apart from that.

Chance parts join many short sets that aren't alike, so a cluster is split before any members are moved: each set has a
sketch, the parities of its members in a hashed bitmap. A bit that differs stands for a member that isn't in both sets,
so sets whose sketches differ in more than ``limit`` bits can't be linked, and only what other sketches join stays a cluster.

Inside a cluster, sets are compared in size-banded tiles: a hashed bitmap for each set, whose differing bits bound the
overlap from above, and the exact intersection of sorted arrays for what is left. Sets that are known to be linked
through others aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import components, importable, saved

WORDS = 5
PERCENT = 80
#: Members and sets that a tile holds, about; two tiles are compared in one task.
TILE_MEMBERS, TILE_SETS = 1_500_000, 8192
BITMAP_WORDS = 16
#: Words of 64 bits that a sketch has at least; one of a larger set has a bit for each member, at least.
SKETCH_WORDS = 16
#: Words whose hashes a worker keeps before it starts anew; it changes speed only.
CACHE = 300_000
#: Size bands are powers of two. In bands below SMALL each member is a part. Above, there are twice as many parts as the
#: largest sets of the band may need, from band MIDDLE on a third more: many parts are less likely to be empty by far.
SMALL, MIDDLE = 8, 9
#: A member is common if so large a share of the documents has it: their number is bounded by the mean set size over it.
COMMON = 1 / 2000
#: Rows without a doc_id get keys from here on.
UNNAMED = 1 << 62
#: Rows that members are counted over at a time, to find those that may be common, and their members, about.
COUNTED, COUNTED_MEMBERS = 10_000, 4_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word n-grams. A-Z count as a-z; words end at ASCII white space."""

    class _Hashes(dict):
        def __missing__(self, word: bytes) -> int:
            import xxhash

            self[word] = value = xxhash.xxh3_64_intdigest(word)
            return value

    def __init__(self, words: int):
        self.words = words
        self._factor = mixed(np.arange(1, words + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        self._hashes = self._Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self._hashes) > CACHE:
            self._hashes.clear()
        words = text.encode().lower().split()
        h = np.fromiter(map(self._hashes.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(h))
        if not size:
            return h
        n = len(h) - size + 1
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = total + h[i : i + n] * self._factor[i]
        return np.unique(mixed(total))


class Rule:
    """The threshold in whole numbers: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def limit(self, sizes):
        """How many members two sets of together ``sizes`` may have that aren't in both."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def largest(self, size):
        """The size of the largest set that may be linked to one of ``size``."""
        return size * 100 // self.percent

    def parts(self, s: np.ndarray, common: np.ndarray, fine: frozenset[int]) -> tuple[np.ndarray, list[int]]:
        """Hashes of the parts that the set with sorted members ``s`` shows, in its own size band and the next, and the
        bands in which it has too few that aren't empty. With ``fine``: those in these bands, each member a part."""
        size = len(s)
        if not size:
            return s, []
        own = size.bit_length() - 1
        most = self.largest(size)
        bands = [(own, min(most, (2 << own) - 1))] + [(own + 1, most)] * (most >= 2 << own)
        if fine:
            bands = [x for x in bands if x[0] in fine]
        rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s] if len(common) and bands else s
        sources = []
        if 2 * len(rare) >= size:
            sources.append((rare, 0))
        if 2 * (len(rare) - self.limit(size + most)) < most:  # or a set linked to it may have fewer
            sources.append((s, 1))
        shown, short = [s[:0]], []
        for members, channel in sources:
            for band, partner in bands:
                need = self.limit(size + partner) + 1
                salt = (4 * band + 2 * bool(fine) + channel) * int(_STEP) % (1 << 64)
                largest = self.limit(2 * ((2 << band) - 1)) + 1
                count = 0 if band < SMALL or fine else largest * 2 if band < MIDDLE else largest * 4 // 3
                found = self._shown(members, need, salt, count)
                short += [band] * (len(found) < need)
                shown.append(found)
        return np.concatenate(shown), short

    @staticmethod
    def _shown(s: np.ndarray, need: int, salt: int, count: int) -> np.ndarray:
        """The first ``need`` of ``count`` parts that have members; with a count of 0 each member is a part."""
        if not count:
            return mixed(s[:need] + np.uint64(salt))
        index = ((s >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(index[1:] != index[:-1]) + 1])
        sums = np.add.reduceat(mixed(s), starts)[:need]
        return mixed(sums + np.uint64(salt) + index[starts[:need]] * _MIX[0])


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mixed(s).sum(dtype=np.uint64), mixed(s * _MIX[1] + _STEP).sum(dtype=np.uint64)
    return tuple(np.array([a, b], np.uint64).view(np.int64).tolist())


def sketch(s: np.ndarray) -> bytes:
    """Whether the number of members is odd, for each of as many bits as a power of two above the size."""
    bits = max(64 * SKETCH_WORDS, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch as it would be with fewer words."""
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _key() -> Column:
    unnamed = F.pmod(F.xxhash64("text"), F.lit(1 << 60)) + F.lit(UNNAMED)
    return F.coalesce(F.col("doc_id").cast("bigint"), unnamed).alias("key")


def common_members(docs: DataFrame, words: int, share: float = COMMON) -> np.ndarray:
    """Members that ``share`` of all documents have, sorted. Counted over all of them, and combined over ``COUNTED``
    rows or the rest of a task, whatever the batches; what is rare in each of these isn't counted, which costs time at most:
    any set of members will do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, some, held = Shingler(words), [], 0
        for batch in batches:
            for text in batch.column(0):
                some.append(shingles(text.as_py()))
                held += len(some[-1])
                if len(some) == COUNTED or held >= COUNTED_MEMBERS:
                    yield often(some)
                    some, held = [], 0
        if some:
            yield often(some)

    def often(some: list[np.ndarray]) -> pa.RecordBatch:
        member, n = np.unique(np.concatenate(some), return_counts=True)
        kept = n >= max(4, share * len(some))
        columns = [pa.array(member[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["member", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "member bigint, n bigint")
    least = share * docs.count()
    found = counted.groupBy("member").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("member").toArrow()
    return np.sort(found["member"].to_numpy().view(np.uint64))


def sets(docs: DataFrame, words: int, rule: Rule, common: np.ndarray, fine: frozenset[int] = frozenset()) -> DataFrame:
    """Of each row: key, set size, the set's hash, its sketch, and the parts it shows, once for equal sets in a task;
    ``short``: the size bands in which it has too few parts."""
    schema = "doc_id bigint, key bigint, n bigint, h1 bigint, h2 bigint, sketch binary, parts array<bigint>, short array<int>"
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most the mean set size over COMMON

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(words), set()
        for batch in batches:
            sizes, first, second, sketches, parts, ends, lacks = [], [], [], [], [np.zeros(0, np.uint64)], [0], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                a, b = set_hashes(s)
                sizes.append(len(s))
                first.append(a)
                second.append(b)
                sketches.append(sketch(s))
                shown, short = (s[:0], []) if (a, b) in seen else rule.parts(s, shared.value, fine)
                seen.add((a, b))
                parts.append(shown)
                lacks.append(short)
                ends.append(ends[-1] + len(shown))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            columns = [pa.array(c, pa.int64()) for c in (sizes, first, second)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *columns,
                    pa.array(sketches, pa.binary()),
                    lists,
                    pa.array(lacks, pa.list_(pa.int32())),
                ],
                names=["doc_id", "key", "n", "h1", "h2", "sketch", "parts", "short"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key(), F.col("text").cast("string"))
    return rows.mapInArrow(look, schema)


def shared_parts(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, by their first hash: each set that shows a part with the first one that shows it.

    Rows of one part stand together after one exchange and a sort; they are read as a stream, whatever their number.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_part, last_lead = None, None
        for batch in batches:
            part, node = (c.to_numpy() for c in batch.columns)
            if not len(part):
                continue
            begins = np.concatenate([[part[0] != last_part], part[1:] != part[:-1]])
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(part)), -1))
            lead = np.where(begin >= 0, node[begin], 0 if last_lead is None else last_lead)
            last_part, last_lead = part[-1], lead[-1]
            other = np.flatnonzero(lead != node)
            pairs = np.unique(np.stack([lead[other], node[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    rows = found.select(F.explode("parts").alias("part"), F.col("h1").alias("node"))
    ordered = rows.repartition("part").sortWithinPartitions("part", "node")
    return ordered.mapInArrow(link, "a bigint, b bigint")


def _linked(rows: pd.DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """Links between the sets of one or two tiles, as few as join what is joined."""
    rows = rows.sort_values(["n", "key"], kind="stable")
    keys, n, side = rows["key"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
    members = [np.frombuffer(x, np.uint64) for x in rows["members"]]
    maps = np.zeros((len(rows), BITMAP_WORDS), np.uint64)
    for i, s in enumerate(members):
        bit = s % np.uint64(64 * BITMAP_WORDS)
        np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
    root, links = np.arange(len(rows)), []
    two = len(set(side.tolist())) > 1
    ends = np.searchsorted(n, rule.largest(n), side="right")
    for i in range(len(rows)):
        later = np.arange(i + 1, ends[i])
        later = later[root[later] != root[i]]
        if two:
            later = later[side[later] != side[i]]
        if not len(later):
            continue
        limit = rule.limit(n[i] + n[later])
        apart = np.bitwise_count(maps[later] ^ maps[i]).sum(axis=1, dtype=np.int64)  # at least so many differ
        for j, most in zip(later[apart <= limit], limit[apart <= limit]):
            if root[j] == root[i]:
                continue
            common = np.isin(members[i], members[j], assume_unique=True).sum()
            if n[i] + n[j] - 2 * common <= most:
                links.append((int(keys[i]), int(keys[j])))
                root[root == root[j]] = root[i]
    return links


def tiles(chosen: DataFrame, percent: int, members: int = TILE_MEMBERS, sets: int = TILE_SETS) -> DataFrame:
    """``chosen`` with the ``tile`` pairs of its cluster that each set takes part in, one row for each, and its ``side``.

    A cluster that is too large for one tile is cut by size bands (a factor of the threshold wide) and, in each, into
    as many shares as it needs; each share meets the shares of its own band and of the next.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("bigint")
    banded = chosen.withColumn("band", band)
    counted = banded.groupBy("cluster", "band").agg(F.count("*").alias("size"), F.sum("n").alias("mass"))
    needed = F.greatest(F.ceil(F.col("mass") / members), F.ceil(F.col("size") / sets))
    shares = counted.select("cluster", "band", needed.alias("shares"))
    one = (F.sum("mass") <= members) & (F.sum("size") <= sets)
    whole = counted.groupBy("cluster").agg(one.alias("one"))
    above = shares.select("cluster", (F.col("band") - 1).alias("band"), F.col("shares").alias("above"))
    below = shares.select("cluster", (F.col("band") + 1).alias("band"), F.col("shares").alias("below"))
    plan = shares.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left").join(whole, "cluster")

    def corner(band: Column, share: Column) -> Column:
        return F.struct(band.cast("bigint").alias("band"), share.cast("bigint").alias("share"))

    def pair(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    share = F.pmod("h1", "shares")
    here = corner(F.col("band"), share)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    none = F.array().cast("array<struct<low:struct<band:bigint,share:bigint>,high:struct<band:bigint,share:bigint>>>")
    own = F.transform(
        upto("shares"), lambda x: pair(corner(F.col("band"), F.least(x, share)), corner(F.col("band"), F.greatest(x, share)))
    )
    up = F.transform(upto("above"), lambda x: pair(here, corner(F.col("band") + 1, x)))
    down = F.transform(upto("below"), lambda x: pair(corner(F.col("band") - 1, x), here))
    nowhere = corner(F.lit(0), F.lit(0))
    all_of_it = F.concat(own, F.coalesce(up, none), F.coalesce(down, none))
    dealt = banded.join(plan, ["cluster", "band"]).withColumn("here", here)
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("one"), F.array(pair(nowhere, nowhere))).otherwise(all_of_it)))
    same = F.col("one") | (F.col("tile.low") == F.col("tile.high")) | (F.col("here") == F.col("tile.low"))
    return dealt.withColumn("side", F.when(same, 0).otherwise(1)).select(*chosen.columns, "tile", "side")


#: Tiles of sketches, which take a 32nd of the members' bytes at most.
sketch_tiles = partial(tiles, members=32 * TILE_MEMBERS)


def _alike(keys: np.ndarray, n: np.ndarray, side: np.ndarray, sketches: list[bytes], rule: Rule) -> list[tuple[int, int]]:
    """Pairs of sets that may be linked, by their sketches, as few as join what all such pairs join."""
    order = np.argsort(n, kind="stable")
    keys, n, side = keys[order], n[order], side[order]
    rows = [np.frombuffer(sketches[k], np.uint64) for k in order]
    widths = np.array([len(x) for x in rows])  # these grow with the size
    ends = np.searchsorted(n, rule.largest(n), side="right")
    root, pairs = np.arange(len(rows)), []
    two = len(set(side.tolist())) > 1
    for width in np.unique(widths).tolist():
        begin, end = np.searchsorted(widths, width, "left"), np.searchsorted(widths, width, "right")
        maps = np.stack([_folded(x, width) for x in rows[begin : ends[end - 1]]], axis=1)
        some = 4 if width <= SKETCH_WORDS else width // 2  # words that tell most sets apart
        for i in range(begin, end):
            if ends[i] == i + 1:
                continue
            others = maps[:, i + 1 - begin : ends[i] - begin]
            limit = rule.limit(n[i] + n[i + 1 : ends[i]])
            apart = np.zeros(len(limit), np.int32)
            for mine, theirs in zip(maps[:some, i - begin], others):
                apart += np.bitwise_count(theirs ^ mine)
            near = np.flatnonzero((apart <= limit) & (root[i + 1 : ends[i]] != root[i]))
            if two:
                near = near[side[near + i + 1] != side[i]]
            apart = np.bitwise_count(others[:, near] ^ maps[:, i - begin, None]).sum(axis=0, dtype=np.int64)
            for j in near[apart <= limit[near]] + i + 1:
                if root[j] != root[i]:
                    pairs.append((int(keys[i]), int(keys[j])))
                    root[root == root[j]] = root[i]
    return pairs


def refined(chosen: DataFrame, rule: Rule) -> DataFrame:
    """``chosen`` (key, h1, h2, n, sketch, cluster) without sketches, and in smaller clusters: of what the sketches of
    sets in one cluster join. Sets that may not be linked with any other are left out."""
    dealt = sketch_tiles(chosen.select("h1", "n", "sketch", "cluster"), rule.percent)

    def compare(rows: pa.Table) -> pa.Table:
        keys, n, side = (rows.column(c).to_numpy() for c in ("h1", "n", "side"))
        pairs = np.array(_alike(keys, n, side, rows.column("sketch").to_pylist(), rule), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    pairs = dealt.groupBy("cluster", "tile").applyInArrow(compare, "a bigint, b bigint")
    clusters = components(saved(pairs, "alike")).select(F.col("node").alias("h1"), F.col("component").alias("cluster"))
    return chosen.select("key", "h1", "h2", "n").join(clusters, "h1").select("key", "h1", "h2", "n", "cluster")


def links(docs: DataFrame, chosen: DataFrame, words: int, rule: Rule) -> DataFrame:
    """Links (a, b) between the sets in ``chosen`` (key, h1, h2, n, cluster), enough to join all that are joined."""
    placed = tiles(chosen, rule.percent).groupBy("key", "h1", "h2", "cluster").agg(
        F.collect_list(F.struct("tile", "side")).alias("places")
    )
    schema = "key bigint, n bigint, members binary, cluster bigint, places " + dict(placed.dtypes)["places"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            found = [shingles(text.as_py()) for text in batch.column(1)]
            marks = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            right = pa.array([set_hashes(s) == mark for s, mark in zip(found, marks)])  # a key may be of several rows
            columns = [
                batch.column(0),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([s.tobytes() for s in found], pa.binary()),
                batch.column(4),
                batch.column(5),
            ]
            names = ["key", "n", "members", "cluster", "places"]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(right)

    texts = docs.select(_key(), F.col("text").cast("string"))
    read = placed.join(texts, "key").select("key", "text", "h1", "h2", "cluster", "places").mapInArrow(look, schema)
    dealt = read.withColumn("place", F.explode("places")).select(
        "cluster", "place.tile", "place.side", "key", "n", "members"
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_linked(rows, rule), columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cluster", "tile").applyInPandas(compare, "a bigint, b bigint")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable by
    links between sets with ``100 * intersection >= percent * union``.

    A text with fewer than ``words`` words is one sequence; null or empty texts are empty sets and linked with
    nothing. Repeated rows and doc_ids are rows of their own, equal sets being linked; a row without a doc_id takes part and gets the
    component's smallest doc_id, or null. Further columns are left out. An empty table stays empty.
    """
    importable(docs.sparkSession)
    rule = Rule(percent)
    common = common_members(docs, words)
    found = saved(sets(docs, words, rule, common), "sets")
    shown = found.select("parts", "h1")
    short = found.select(F.explode("short").alias("band")).distinct().collect()  # size bands: below 64
    if short:  # a set had too few parts, which is next to impossible: single members as well, in its band
        finer = sets(docs, words, rule, common, frozenset(r[0] for r in short))
        shown = shown.unionByName(saved(finer.select("parts", "h1").filter("size(parts) > 0"), "finer"))
    some = found.filter("n > 0")
    distinct = saved(
        some.groupBy("h1", "h2").agg(
            F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
        ),
        "distinct",
    )
    clusters = components(saved(shared_parts(shown), "shared"))
    sharing = saved(
        distinct.join(clusters.select(F.col("node").alias("h1"), F.col("component").alias("cluster")), "h1").select(
            "key", "h1", "h2", "n", "sketch", "cluster"
        ),
        "sharing",
    )
    chosen = saved(refined(sharing, rule), "chosen")
    joins = components(saved(links(docs, chosen, words, rule), "links"))
    joins = joins.select(F.col("node").alias("key"), "component")
    # Only sets with copies or links have a component other than themselves.
    classes = distinct.join(joins, "key", "left").filter("copies > 1 or component is not null")
    classes = classes.select("h1", "h2", F.coalesce("component", "key").alias("component"))
    thin = some.select("doc_id", "key", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.coalesce("component", "key")
    named = thin.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(component < UNNAMED, component).alias("component_id"),
    )
    empty = found.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(empty)


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs``, same columns, with one document of each component: the one with the smallest doc_id.

    Rows of one doc_id are one document and stay or go together. A row without a doc_id stays. ``docs`` is read several
    times: a stored table.
    """
    found = joined(docs.select("doc_id", "text"), words, percent)
    others = found.filter("component_id < doc_id").select(F.col("doc_id").alias("_other")).distinct()
    same = F.col("doc_id").cast("bigint") == F.col("_other")
    return docs.join(others, same, "left_anti")

"""Approximate nearest neighbours by inner product, over a neighbour graph built by NN-descent.

Vectors are lengthened by one component so that all have one norm; then the largest inner products belong to the nearest
vectors, also where norms differ. The graph begins with neighbours inside blocks of vectors that have the same nearest
pivots, for several drawings of pivots. Each round of NN-descent joins every vector's neighbours and reverse neighbours
with their vectors and compares them with each other: neighbours of neighbours become neighbours.

A query walks the graph greedily: it begins at the pivots nearest to it (and at its own neighbours, where it is a vector
of the graph), expands the best vectors seen that it hasn't expanded, and scores what they lead to exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.llm.common import importable, saved

#: Neighbours in the graph; vectors in a block; drawings of pivots; pivots in one, at most; rounds of NN-descent.
DEGREE, BLOCK, DRAWINGS, PIVOTS, ROUNDS = 24, 1024, 14, 4096, 2
#: Vectors a query keeps and expands, how often, and the pivots it begins at, of so many.
BEAM, STEPS, ENTRIES, ENTRY_PIVOTS = 80, 3, 8, 1024
#: Vectors whose scores are computed in one task.
SCORED = 20_000
SEED = 11

_GRAPH = "id bigint, ids array<bigint>, scores array<float>"


def usable(rows: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``id`` and ``vec`` (doubles) of the vectors that take part: not null or zero, no null or non-finite component,
    and as long as the longest. Rows repeated with one id count once, with their smallest vector."""
    vec = F.col(value).cast("array<double>")
    infinite = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(vec, lambda x: x != 0)
    known = rows.filter(F.col(key).isNotNull() & vec.isNotNull() & fine)
    known = known.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(vec).alias("vec"))
    size = known.agg(F.max(F.size("vec"))).first()[0] or 0
    return known.filter(F.size("vec") == size)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best different ids, best first."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:most]], scores[first[:most]]


def _graph_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "ids", "scores"])


def _inside(ids: np.ndarray, x: np.ndarray, most: int) -> list[tuple]:
    """Each vector's nearest among those that stand here."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(most, len(ids) - 1)
    if k < 1:
        return []
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return list(zip(ids.tolist(), ids[top], np.take_along_axis(s, top, 1).astype(np.float32)))


def merged(lists: DataFrame, degree: int) -> DataFrame:
    """One list for each id out of any number: they are read in order, a few at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, scores = None, np.zeros(0, np.int64), np.zeros(0, np.float32)
        for batch in batches:
            out = []
            for i, more, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                more, values = more.values.to_numpy(), values.values.to_numpy()
                if i == last:
                    ids, scores = _best(np.concatenate([ids, more]), np.concatenate([scores, values]), degree)
                    continue
                if last is not None:
                    out.append((last, ids, scores))
                last, (ids, scores) = i, _best(more, values, degree)
            yield _graph_rows(out)
        if last is not None:
            yield _graph_rows([(last, ids, scores)])

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(merge, _GRAPH)


def lengthened(vectors: DataFrame) -> DataFrame:
    """``id`` and ``x``: the vectors in single precision with a component more, all of one norm."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    most = vectors.agg(F.max(square)).first()[0] or 0.0
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - square))
    return vectors.select("id", F.array_append("vec", rest).cast("array<float>").alias("x"))


def _sample(x: DataFrame, most: int, draw: int) -> np.ndarray:
    """At most ``most`` vectors, chosen by a hash of their ids: the same whatever the partitioning."""
    rows = x.orderBy(F.xxhash64("id", F.lit(SEED + draw)), "id").limit(most).toArrow()
    return _matrix(rows["x"].combine_chunks()) if len(rows) else np.zeros((0, 1), np.float32)


def blocks(x: DataFrame, count: int, degree: int, block: int, drawings: int) -> DataFrame:
    """The graph to begin with: neighbours inside blocks of ``block`` vectors that follow each other when ordered by their two
    nearest pivots. Pivots are a bounded sample (``PIVOTS`` for each drawing); every vector is in a block of each."""
    sizes = max(2, min(PIVOTS, count // max(1, block // 2)))
    drawn = _sample(x, sizes * drawings, 0)
    shared = x.sparkSession.sparkContext.broadcast(drawn)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = [shared.value[t::drawings] for t in range(drawings)]
        for batch in batches:
            if not len(batch):
                continue
            rows = _matrix(batch.column(1))
            for t, some in enumerate(pivots):
                if not len(some):
                    some = shared.value[:1]
                near = np.argsort(-(rows @ some.T), axis=1)[:, :2].astype(np.int64)
                key = (t << 40) | (near[:, 0] << 20) | near[:, -1]
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "id", "x"])

    ordered = x.mapInArrow(order, "key bigint, id bigint, x array<float>")
    ordered = ordered.repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, rows = [], [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy() >> 40)
            ids.append(batch.column(1).to_numpy())
            rows.append(_matrix(batch.column(2)) if len(batch) else np.zeros((0, 1), np.float32))
            key, i, r = (np.concatenate([y for y in z if len(y)]) if any(map(len, z)) else z[0] for z in (keys, ids, rows))
            whole = len(key) // block * block
            for start in range(0, whole, block):
                yield _graph_rows(group(key[start : start + block], i[start : start + block], r[start : start + block]))
            keys, ids, rows = [key[whole:]], [i[whole:]], [r[whole:]]
        if keys and len(keys[0]):
            yield _graph_rows(group(keys[0], ids[0], rows[0]))

    def group(key: np.ndarray, i: np.ndarray, r: np.ndarray) -> list[tuple]:
        return [row for t in np.unique(key) for row in _inside(i[key == t], r[key == t], degree)]

    return merged(ordered.mapInArrow(compare, _GRAPH), degree)


def beside(graph: DataFrame, degree: int) -> DataFrame:
    """(node, member, floor): each node's neighbours, and its ``degree`` best reverse neighbours. ``floor`` is the
    score from which on the member gains by another neighbour."""
    edges = graph.select("id", F.explode(F.arrays_zip("ids", "scores")).alias("e"))
    edges = edges.select("id", F.col("e.ids").alias("to"), F.col("e.scores").alias("score"))
    best = Window.partitionBy("to").orderBy(F.desc("score"), "id")
    back = edges.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= degree)
    ahead = edges.select(F.col("id").alias("node"), F.col("to").alias("member"))
    return ahead.unionByName(back.select(F.col("to").alias("node"), F.col("id").alias("member"))).distinct()


def descended(graph: DataFrame, x: DataFrame, degree: int) -> DataFrame:
    """One round: the members beside each node are joined with their vectors and compared with each other."""
    floor = graph.select("id", F.when(F.size("ids") >= degree, F.array_min("scores")).otherwise(F.lit(-1e30)).alias("floor"))
    known = x.join(floor, "id", "left").select(F.col("id").alias("member"), "x", F.coalesce("floor", F.lit(-1e30)).alias("floor"))
    together = beside(graph, degree).join(known, "member").select("node", "member", "x", "floor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            part = [
                batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)), batch.column(3).to_numpy()
            ]
            if kept is not None:
                part = [np.concatenate(y) for y in zip(kept, part)]
            last = np.searchsorted(part[0], part[0][-1])  # the last node's members may go on in the next batch
            kept = [y[last:] for y in part]
            yield _graph_rows(group(*(y[:last] for y in part)))
        if kept is not None:
            yield _graph_rows(group(*kept))

    def group(node: np.ndarray, member: np.ndarray, rows: np.ndarray, least: np.ndarray) -> list[tuple]:
        out = []
        cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = rows[a:b] @ rows[a:b].T
            np.fill_diagonal(s, -np.inf)
            gains = s > least[a:b, None]
            for i in np.flatnonzero(gains.any(axis=1)):
                at = np.flatnonzero(gains[i])
                out.append((int(member[a + i]), member[a + at], s[i, at].astype(np.float32)))
        return out

    found = together.repartition("node").sortWithinPartitions("node").mapInArrow(compare, _GRAPH)
    return merged(graph.unionByName(found), degree)


def neighbour_graph(x: DataFrame, degree: int = DEGREE, block: int = BLOCK, drawings: int = DRAWINGS, rounds: int = ROUNDS):
    """The graph of ``x`` (id, x: distinct ids, stored): ``id``, ``ids``, ``scores``, best first."""
    importable(x.sparkSession)
    graph = saved(blocks(x, x.count(), degree, block, drawings), "graph")
    for _ in range(rounds):
        graph = saved(descended(graph, x, degree), "graph")
    return graph


def _scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, count: int) -> DataFrame:
    """(query, id, score) of pairs (query, id): exact inner products. Vectors come into blocks; each query goes to the blocks of its
    candidates once, with their ids, so vectors aren't repeated for pairs."""
    groups = max(1, -(-count // SCORED))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    asked = pairs.groupBy("query", of("id").alias("block")).agg(F.collect_list("id").alias("ids")).join(queries, "query")
    held = vectors.select(of("id").alias("block"), "id", "vec")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        left = left.sort_values("id")
        ids, rows = left["id"].to_numpy(), _matrix(left["vec"])
        query, found, scores = [], [], []
        for q, wanted, vec in zip(right["query"], right["ids"], right["q"]):
            wanted = np.asarray(wanted)
            scores.append(rows[np.searchsorted(ids, wanted)] @ np.asarray(vec))
            query.append(np.full(len(wanted), q))
            found.append(wanted)
        return pd.DataFrame({"query": np.concatenate(query), "id": np.concatenate(found), "score": np.concatenate(scores)})

    return held.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(
        score, "query bigint, id bigint, score double"
    )


def _top(seen: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def searched(
    queries: DataFrame, vectors: DataFrame, x: DataFrame, graph: DataFrame, beam: int = BEAM, steps: int = STEPS
) -> DataFrame:
    """(query, id, score): the best ``beam`` vectors found for each of ``queries`` (query, q).

    ``vectors`` (id, vec), ``x`` and ``graph`` are stored tables. A query whose number is an id of the graph begins at
    its own neighbours too.
    """
    importable(vectors.sparkSession)
    count = vectors.count()
    entry = x.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(ENTRY_PIVOTS).join(vectors, "id").select("id", "vec").toArrow()
    pivots = vectors.sparkSession.sparkContext.broadcast((entry["id"].to_numpy(), entry["vec"].to_pylist()))  # ENTRY_PIVOTS

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = pivots.value
        rows = np.array(rows)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            s = _matrix(batch.column(1)) @ rows.T
            near = np.argsort(-s, axis=1, kind="stable")[:, :ENTRIES]
            query = np.repeat(batch.column(0).to_numpy(), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[near.ravel()])], names=["query", "id"])

    links = saved(beside(graph, DEGREE), "links")
    ways = links.select(F.col("node").alias("from"), F.col("member").alias("id"))
    own = ways.join(queries.select(F.col("query").alias("from")), "from").select(F.col("from").alias("query"), "id")
    itself = queries.select("query", F.col("query").alias("id")).join(vectors.select("id"), "id", "left_semi")
    first = queries.select("query", "q").mapInArrow(begin, "query bigint, id bigint").unionByName(own).unionByName(
        itself.select("query", "id")
    )
    seen = saved(_scores(first.distinct(), queries, vectors, count).withColumn("step", F.lit(0)), "seen")
    for step in range(1, steps + 1):
        # What was expanded before is in the beam of the step before: only what came in since is new.
        todo = _top(seen, beam).filter(F.col("step") == step - 1).select("query", F.col("id").alias("from"))
        led = todo.join(ways, "from").select("query", "id").distinct()
        new = led.join(seen.select("query", "id"), ["query", "id"], "left_anti")
        found = _scores(new, queries, vectors, count).withColumn("step", F.lit(step))
        seen = saved(_top(seen, beam).drop("rank").unionByName(found), "seen")
    return _top(seen, beam).select("query", "id", "score")


def nearest(rows: DataFrame, asked: Column, most: int = 20, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """For each row that ``asked`` (over ``id``) chooses, its ``most`` nearest other rows: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score`` (the inner product in double precision), ties to the smaller vec_id.

    Rows with equal vectors are one vector of the graph; of each, the ``most`` + 1 smallest ids are enough, and kept. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do shorter ones; repeated ids count once;
    further columns are left out.
    """
    importable(rows.sparkSession)
    members = saved(usable(rows, key, value), "vectors")
    ranked = members.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
    ranked = ranked.withColumn("of", F.min("id").over(Window.partitionBy("vec")))
    kept = saved(ranked.filter((F.col("n") <= most + 1) | asked).select("id", "of", "n"), "copies")
    distinct = saved(members.join(kept.filter("n = 1").select("id"), "id"), "distinct")
    x = saved(lengthened(distinct), "lengthened")
    graph = neighbour_graph(x)
    chosen = kept.filter(asked).select("id", "of")
    queries = saved(
        chosen.select(F.col("of").alias("query")).distinct().join(distinct.select(F.col("id").alias("query"), F.col("vec").alias("q")), "query"),
        "queries",
    )
    found = searched(queries, distinct, x, graph, max(BEAM, most + 1))
    near = _top(found, most + 1).select("query", F.col("id").alias("of"), "score")
    listed = near.join(kept.filter(F.col("n") <= most + 1).select("of", "id"), "of").select("query", "id", "score")
    asked_for = chosen.select(F.col("of").alias("query"), F.col("id").alias("query_id"))
    out = _top(listed, most + 1).drop("rank").join(asked_for, "query").filter("id != query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")

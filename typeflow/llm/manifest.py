"""A Merkle manifest of a dataset, with inclusion proofs by octopus multiproofs.

Every row is a leaf. The leaves of a language form a tree by doc_id, and the languages' subroots the tree above them, so
that a changed row, language or table shows in the root. Trees are built in aligned blocks of 2^10 neighbours, each by
one task, and blocks of blocks until one node is left; only nodes from the blocks' tops up are stored.

Proving every row one by one would fetch the same siblings over and over. Instead the leaves are cut into partitions of
whole blocks; each computes which nodes its rows need and it can't derive (the octopus's arms), a set of about one path,
fetches them by one join, derives all interiors that its rows share, and writes out each row's proof by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import saved
from typeflow.llm.ordered import running

#: Leaves of a block, and of a partition (whole blocks that begin in its stretch), as powers of two.
BLOCK_BITS, PARTITION_BITS = 10, 13
#: Key of the tree over the languages' subroots. A language's key begins with one of two other letters.
TOP = "t"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, colon and value; numbers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(changed: dict[str, Column] | None = None) -> Column:
    fields = {name: F.col(name) for name in FIELDS} | (changed or {})
    return F.sha2(F.concat(*[encoded(fields[name]) for name in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id``, ``tree`` (the language's key), ``leaf``, and ``shown``: the leaf as somebody presents it, which differs
    where ``tampered`` holds and the row has ``n_chars``, to which one is added."""
    leaf = leaf_of()
    shown = leaf
    if tampered is not None:
        shown = F.when(tampered & F.col("n_chars").isNotNull(), leaf_of({"n_chars": F.try_add("n_chars", F.lit(1))})).otherwise(leaf)
    # Keys sort as the languages do, NULL first.
    tree = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), shown.alias("shown"))


# Trees by level: node (level, i) stands over nodes (level - 1, 2i) and (level - 1, 2i + 1), where both exist.


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(int(n) - 1, 0).bit_length()


def width(n: int, level: int) -> int:
    """Nodes of a level."""
    return -(-int(n) >> level) if level else int(n)


def levels_above(digests: Sequence[str], count: int) -> list[list[str]]:
    """``digests`` and up to ``count`` levels above them, as far as one node."""
    levels = [list(digests)]
    for _ in range(count):
        below = levels[-1]
        levels.append([_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def missing(known: set[int], start: int, n: int) -> list[tuple[int, int]]:
    """The arms: coordinates (level, i) needed to derive the root from the nodes ``known`` of level ``start``, in a tree of
    ``n`` leaves; none that other known nodes give."""
    arms = []
    for level in range(start, height(n)):
        arms += [(level, i ^ 1) for i in known if i ^ 1 not in known and i ^ 1 < width(n, level)]
        known = {i >> 1 for i in known}
    return arms


def derived(nodes: dict[tuple[int, int], str], known: set[int], start: int, n: int) -> None:
    """Adds to ``nodes``, which holds the known nodes and their arms, all nodes on the way to the root."""
    for level in range(start, height(n)):
        known = {i >> 1 for i in known}
        for i in known:
            pair = [nodes[level, j] for j in (2 * i, 2 * i + 1) if j < width(n, level)]
            nodes[level + 1, i] = _hash(*pair)


def siblings(nodes: dict[tuple[int, int], str], i: int, start: int, n: int) -> Iterator[tuple[str | None, bool]]:
    """The sibling of each node from (start, i) up to the root's children, and whether it stands to the left."""
    for level in range(start, height(n)):
        yield nodes.get((level, i ^ 1)) if i ^ 1 < width(n, level) else None, bool(i & 1)
        i >>= 1


def _build_blocks(level: int):
    """Levels above the nodes of a block, which are of ``level``; ``n`` is the number of the tree's leaves."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        n, first = int(block["n"].iloc[0]), int(block["i"].iloc[0])
        above = levels_above(block["digest"].tolist(), min(BLOCK_BITS, height(n) - level))
        rows = [
            (block["tree"].iloc[0], n, level + up, (first >> up) + k, digest)
            for up, digests in enumerate(above)
            if up
            for k, digest in enumerate(digests)
        ]
        return pd.DataFrame(rows, columns=["tree", "n", "level", "i", "digest"])

    return build


NODES = "tree string, n bigint, level int, i bigint, digest string"


def _height(n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, 2))).cast("int")


def _interiors(bottom: DataFrame, highest: int, lowest: int) -> tuple[DataFrame, DataFrame]:
    """From trees' leaves (``tree``, ``n``, ``i``, ``digest``): their roots (``tree``, ``n``, ``digest``), and all nodes above
    the leaves from level ``lowest`` up. ``highest`` is the height of the highest tree."""
    at_root = F.col("level") == _height(F.col("n"))
    roots = bottom.filter("n = 1").select("tree", "n", "digest")
    nodes, current = bottom.limit(0).select("tree", "n", F.lit(0).alias("level"), "i", "digest"), bottom
    for level in range(0, highest, BLOCK_BITS):
        rising = current.filter(F.col("n") > F.lit(1 << level)).select("tree", "n", "i", "digest")
        built = rising.groupBy("tree", F.shiftright("i", BLOCK_BITS).alias("block")).applyInPandas(_build_blocks(level), NODES)
        built = saved(built.filter((F.col("level") >= lowest) | at_root), "interiors")
        nodes = nodes.unionByName(built.filter(F.col("level") >= lowest))
        roots = roots.unionByName(built.filter(at_root).select("tree", "n", "digest"))
        current = built.filter(F.col("level") == level + BLOCK_BITS)
    return roots, nodes


def _missing_of(blocks: pd.DataFrame) -> pd.DataFrame:
    """The arms of one partition, from its blocks (``part``, ``tree``, ``n``, ``block``, ``place``, ``n_trees``)."""
    part, rows = blocks["part"].iloc[0], []
    for tree, own in blocks.groupby("tree"):
        n = int(own["n"].iloc[0])
        if height(n) > BLOCK_BITS:
            rows += [(part, tree, level, i) for level, i in missing(set(own["block"].tolist()), BLOCK_BITS, n)]
    places = set(blocks["place"].tolist())
    rows += [(part, TOP, level, i) for level, i in missing(places, 0, int(blocks["n_trees"].iloc[0]))]
    return pd.DataFrame(rows, columns=["part", "tree", "level", "i"])


def _fold(leaf: str, path: list[tuple[str | None, bool]]) -> str:
    for sibling, left in path:
        leaf = _hash(leaf) if sibling is None else _hash(sibling, leaf) if left else _hash(leaf, sibling)
    return leaf


def _proofs(own: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Proofs of a partition's rows from its leaves and the arms it fetched."""
    if own.empty:
        return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])
    arms: dict[str, dict[tuple[int, int], str]] = {}
    for tree, level, i, digest in zip(fetched["tree"], fetched["level"], fetched["i"], fetched["digest"]):
        arms.setdefault(tree, {})[level, i] = digest
    n_trees = int(own["n_trees"].iloc[0])
    top = arms.get(TOP, {})
    trees = {}
    for tree, rows in own.groupby("tree"):
        rows = rows.sort_values("i")
        n, nodes = int(rows["n"].iloc[0]), arms.get(tree, {})
        indices, digests = rows["i"].to_numpy(), rows["leaf"].tolist()
        numbers = indices >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(rows)]):
            first = int(indices[low])
            for up, level in enumerate(levels_above(digests[low:high], min(BLOCK_BITS, height(n)))):
                nodes.update(((up, (first >> up) + k), digest) for k, digest in enumerate(level))
        derived(nodes, set(numbers.tolist()), BLOCK_BITS, n)
        trees[tree] = (n, nodes, rows)
        top[0, int(rows["place"].iloc[0])] = nodes[height(n), 0]
    derived(top, set(own["place"].tolist()), 0, n_trees)
    root = top[height(n_trees), 0]

    out = []
    for n, nodes, rows in trees.values():
        above = list(siblings(top, int(rows["place"].iloc[0]), 0, n_trees))
        subroot = nodes[height(n), 0]
        for doc_id, leaf, shown, i in zip(rows["doc_id"], rows["leaf"], rows["shown"], rows["i"]):
            path = [*siblings(nodes, int(i), 0, n), *above]
            proof = _hash(*[sibling for sibling, _ in path if sibling is not None])
            out.append((doc_id, leaf, subroot, root, proof, _fold(shown, path)))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leaves with their places, the subroots with theirs, and the stored nodes of all trees.

    Leaves of a language ascend by doc_id, NULL first, then by leaf, so repeated rows are leaves side by side. Columns
    other than the five that a leaf covers are left out.
    """
    numbered = saved(
        running(saved(leaves(docs, tampered), "leaves"), ["tree"], ["doc_id", "leaf", "shown"], {"place_in_tree": F.lit(1)}),
        "numbered-leaves",
    )
    counts = saved(numbered.groupBy("tree").agg(F.count("*").alias("n")), "trees")
    order = {"before": F.col("n"), "place": F.lit(1)}
    trees = running(counts, [], ["tree"], order).select(
        "tree", "n", (F.col("before") - F.col("n")).alias("first"), (F.col("place") - 1).alias("place")
    )
    trees = saved(trees.withColumn("n_trees", counts.select(F.count("*")).scalar()), "tree-places")
    i = (F.col("place_in_tree") - 1).alias("i")
    placed = saved(
        numbered.join(trees, "tree").select("doc_id", "tree", "leaf", "shown", i, "n", "first", "place", "n_trees"), "placed-leaves"
    )
    highest, n_trees = trees.agg(F.max("n"), F.count("*")).first()
    bottom = placed.select("tree", "n", "i", F.col("leaf").alias("digest"))
    subroots, nodes = _interiors(bottom, height(highest or 0), BLOCK_BITS)
    tops = saved(
        subroots.join(trees, ["tree", "n"]).select(
            F.lit(TOP).alias("tree"), F.col("n_trees").alias("n"), F.col("place").alias("i"), "digest"
        ),
        "subroots",
    )
    # The upper tree is stored whole: its leaves are spread over the partitions.
    _, upper = _interiors(tops, height(n_trees), 1)
    return placed, tops, nodes.unionByName(tops.withColumn("level", F.lit(0))).unionByName(upper)


def proofs(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each leaf ``subroot``, ``root``, ``proof_sha256`` (over its siblings, from the leaf up) and ``folded_root``: the
    root that the presented leaf and the original siblings give."""
    block = F.shiftright("i", BLOCK_BITS)
    # Where a block begins among all leaves decides its partition, so small languages share one.
    part = F.shiftright(F.col("first") + F.shiftleft(block, BLOCK_BITS), PARTITION_BITS)
    own = placed.withColumn("block", block).withColumn("part", part)
    blocks = own.select("part", "tree", "n", "block", "place", "n_trees").distinct()
    arms = saved(
        blocks.groupBy("part").applyInPandas(_missing_of, "part bigint, tree string, level int, i bigint"), "arms"
    )
    fetched = saved(
        arms.join(nodes.select("tree", "level", "i", "digest"), ["tree", "level", "i"]).select(
            "part", "tree", "level", "i", "digest"
        ),
        "fetched",
    )
    leaves_by_part = own.select("part", "doc_id", "tree", "leaf", "shown", "i", "n", "place", "n_trees").groupBy("part")
    return leaves_by_part.cogroup(fetched.groupBy("part")).applyInPandas(_proofs, PROOFS)


def verified(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Every row with its proof, and whether what is presented of it (see :func:`leaves`) folds to the root.

    An empty table has no rows and no root.
    """
    placed, _, nodes = manifest(docs, tampered)
    return proofs(placed, nodes).withColumn("verified", F.col("folded_root") == F.col("root"))

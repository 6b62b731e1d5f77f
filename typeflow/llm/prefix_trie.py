"""The trie of conversation prefixes, by an Euler tour.

Conversations share openings: each distinct sequence of first turns is a node, and what a node saves is what its copies
would cost again. A node has an enter and an exit arc; the tour through all arcs is a linked list whose pointers follow
from sibling numbers alone. Ranking the list without walking it gives every arc its position, and as a subtree is the
stretch between a node's two arcs, its leaves and savings are differences of prefix sums at their positions.

No step holds a conversation, the children of a node or a subtree in one task: turns and siblings are numbered over
ranges of a sort, prefixes are named by running sums of turn digests, and pointers come from one join by unique slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import saved
from typeflow.llm.ordered import prefix_sums, ranked, running

#: Conversations of one family share the opening of the first of them; how much depends on the conversation.
FAMILY, OPENINGS = 5, 9
#: Conversation ids that are hashed as one text, and depths whose arcs are sorted together.
CHUNK_BITS, STRETCH_BITS = 9, 10
EMPTY_SHA = hashlib.sha256().hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` (from 1), ``digest`` of role and text, ``bytes`` of the text.

    Turns are ordered by ``turn``, NULL first, ties by digest; a NULL role or text is empty. Rows without a conv_id
    belong to no conversation. Repeated rows are turns of their own; they are counted first and spread out again.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    size = F.octet_length(role).cast("string")
    turns = (
        conversations.filter("conv_id is not null")
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            "turn",
            F.sha2(F.concat(size, F.lit(":"), role, text), 256).alias("digest"),
            F.octet_length(text).cast("bigint").alias("bytes"),
        )
        .groupBy("conv_id", "turn", "digest")
        .agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"))
    )
    placed = running(saved(turns, "turns"), ["conv_id"], ["turn", "digest"], {"upto": F.col("copies")})
    return placed.select(
        "conv_id", F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto"))).alias("i"), "digest", "bytes"
    )


def opening_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(OPENINGS)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the rebuilt turns: the opening is that of the family's first conversation.

    A conversation takes ``opening_length`` turns of it (all if it has fewer, none if it isn't there), and goes on with
    its own turns behind as many of its own.
    """
    head = turns.filter((F.col("i") < OPENINGS) & (F.col("conv_id") % FAMILY == 0)).groupBy("conv_id")
    heads = head.agg(F.sort_array(F.collect_list(F.struct("i", "digest", "bytes"))).alias("head"))
    ids = turns.select("conv_id").distinct()
    taking = (
        ids.withColumn("wanted", opening_length(F.col("conv_id")))
        .withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(heads.withColumnRenamed("conv_id", "family"), "family", "left")
        .withColumn("head", F.expr("coalesce(slice(head, 1, cast(wanted as int)), array())"))
    )
    taking = saved(taking.select("conv_id", "wanted", "head"), "openings")
    short = taking.filter(F.size("head") < F.col("wanted")).select(
        "conv_id", (F.col("wanted") - F.size("head")).alias("less")
    )
    own = (
        turns.filter(F.col("i") > opening_length(F.col("conv_id")))
        .join(short, "conv_id", "left")
        .select("conv_id", (F.col("i") - F.coalesce("less", F.lit(0))).alias("depth"), "digest", "bytes")
    )
    opened = taking.select("conv_id", F.explode("head").alias("turn")).select(
        "conv_id", F.col("turn.i").alias("depth"), "turn.digest", "turn.bytes"
    )
    return taking.select("conv_id"), saved(opened.unionByName(own), "rebuilt")


def _words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _key(sums: list[Column]) -> list[Column]:
    """126 bits of the four sums."""
    high, low = F.lit(1 << 32), F.lit(1 << 31)
    return [F.pmod(sums[k], high) * low + F.pmod(sums[k + 1], low) for k in (0, 2)]


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``conv_id``, ``depth``, its name (``k1``, ``k2``), its parent's, ``bytes``.

    A prefix is named by the sum, over its turns, of SHA-256 words of (position, turn), so that names are running sums.
    """
    words = _words(F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256))
    worded = turns.select("conv_id", "depth", "bytes", *[word.alias(f"w{k}") for k, word in enumerate(words)])
    summed = running(worded, ["conv_id"], ["depth"], {f"s{k}": F.col(f"w{k}") for k in range(4)})
    k1, k2 = _key([F.col(f"s{k}") for k in range(4)])
    p1, p2 = _key([F.col(f"s{k}") - F.col(f"w{k}") for k in range(4)])
    return summed.select(
        "conv_id", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "bytes"
    )


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, which come sorted, joined by commas."""
    node, state = None, None
    for batch in batches:
        done = []
        for k1, k2, text in zip(batch["k1"], batch["k2"], batch["ids"]):
            if (k1, k2) == node:
                state.update(b"," + text.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (k1, k2), hashlib.sha256(text.encode())
        yield pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def ends_digests(ids: DataFrame, named: DataFrame) -> DataFrame:
    """For each node at which conversations end, SHA-256 of their ids, ascending, joined by commas.

    Ids are numbered inside their node over a distributed sort and joined in chunks of 512, so that the one pass which a
    hash needs reads a row for each chunk.
    """
    last = named.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last"))
    ends = ids.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"last.{k}"), F.lit(0)).cast("bigint").alias(k) for k in ("k1", "k2")]
    )
    placed = running(saved(ends, "ends"), ["k1", "k2"], ["conv_id"], {"n": F.lit(1)})
    listed = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = placed.groupBy("k1", "k2", F.shiftright(F.col("n") - 1, CHUNK_BITS).alias("chunk")).agg(
        F.array_join(listed, ",").alias("ids")
    )
    return (
        chunks.repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "chunk")
        .select("k1", "k2", "ids")
        .mapInPandas(_hashed, "k1 bigint, k2 bigint, ends_sha256 string")
    )


def nodes_of(ids: DataFrame, named: DataFrame) -> DataFrame:
    """The trie's nodes below the root, with ``parent_conv_id``: a node is known by its smallest member and its depth."""
    nodes = saved(
        named.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.count("*").alias("n_convs"),
            F.max("bytes").alias("bytes"),
            F.max("p1").alias("p1"),
            F.max("p2").alias("p2"),
        ),
        "nodes",
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.filter("depth = 1").withColumn("parent_conv_id", ids.select(F.min("conv_id")).scalar())
    below = nodes.filter("depth > 1").join(parents, ["p1", "p2"])
    return below.unionByName(top).drop("p1", "p2")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie, the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree, ``ends_sha256``. A table without a conv_id has no nodes. See :func:`numbered_turns`
    and :func:`rebuilt` for NULLs, ties and repeated rows; other columns are left out.
    """
    ids, turns = rebuilt(saved(numbered_turns(conversations), "numbered"))
    named = saved(prefixes(turns), "prefixes")

    numbered = running(
        saved(nodes_of(ids, named), "linked"), ["parent_conv_id", "depth"], ["conv_id"], {"child": F.lit(1)}
    )
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = (
        ids.groupBy()
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
        .filter("n_convs > 0")
        .select(
            zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"),
            nothing.alias("parent_conv_id"), F.lit(-1).cast("bigint").alias("row_id"), nothing.alias("child"),
        )
    )
    numbered = saved(numbered.unionByName(root), "siblings")
    families = numbered.filter("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    )
    nodes = saved(
        numbered.join(families.agg(F.count("*").alias("n_children")), ["conv_id", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("enter", (F.col("row_id") + 1) * 2)
        .withColumn("exit", (F.col("row_id") + 1) * 2 + 1),
        "trie",
    )

    # A node's slots: its children in order, then its own exit. Each arc but the last leads to one slot.
    slots = (
        nodes.filter("depth > 0")
        .select(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d"), F.col("child").alias("slot"), F.col("enter").alias("next"))
        .unionByName(nodes.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), (F.col("n_children") + 1).alias("slot"), F.col("exit").alias("next")))
    )
    stretch = F.shiftright("depth", STRETCH_BITS)
    arcs = (
        nodes.select(
            F.col("enter").alias("id"), F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(1).cast("bigint").alias("slot"),
            F.struct("conv_id", stretch.alias("part")).alias("home"), F.col("depth").alias("seq"),
        ).unionByName(
            nodes.select(
                F.col("exit").alias("id"), F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d"), (F.col("child") + 1).alias("slot"),
                F.struct("conv_id", (-1 - stretch).alias("part")).alias("home"), (-F.col("depth")).alias("seq"),
            )
        )
    )
    links = saved(arcs.join(slots, ["c", "d", "slot"], "left").select("id", "next", "home", "seq"), "arcs")

    leaf = (F.col("n_children") == 0).cast("bigint")
    weights = nodes.select(
        F.col("enter").alias("id"), leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    ).unionByName(nodes.select(F.col("exit").alias("id"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    tour = saved(ranked(links).join(weights, "id"), "tour")
    totals = saved(prefix_sums(tour, "position", ["n_leaves", "saved_tokens"]), "tour-sums")
    # A subtree's sum is that up to the exit arc less that before the enter arc.
    side = F.when(F.col("id") % 2 == 0, -1).otherwise(1)
    subtrees = totals.groupBy((F.shiftright("id", 1) - 1).alias("row_id")).agg(
        F.sum(side * F.col("n_leaves")).alias("n_leaves"), F.sum(side * F.col("saved_tokens")).alias("saved_tokens")
    )
    return (
        nodes.join(subtrees, "row_id")
        .join(ends_digests(ids, named), ["k1", "k2"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("n_leaves") + leaf).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )

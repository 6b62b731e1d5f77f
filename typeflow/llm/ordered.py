"""Running sums over an order that no single task holds, and ranks of linked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeflow.llm.common import parallelism, saved


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums inside each group in the given order, the row itself included, and a unique ``row_id``.

    Rows are dealt out by ranges of (group, order), so that a group of any size is cut over many tasks. Each range sums
    on its own; what a group has in the ranges before comes from a table of one row for each range. Rows that tie in
    group and order are numbered in any order. ``sums`` are whole numbers; NULLs count as 0.
    """
    group, names = list(group), list(sums)
    keys = [*group, *order]
    weighted = df.select("*", *[F.coalesce(weight.cast("bigint"), F.lit(0)).alias(f"_w_{n}") for n, weight in sums.items()])
    spread = saved(
        weighted.repartitionByRange(parallelism(df.sparkSession), *(keys or ["_w_" + names[0]])).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranges",
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    same = Window.partitionBy("_part", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.select(
        "*",
        *[F.sum(f"_w_{n}").over(same).alias(n) for n in names],
        ((F.col("_part").cast("bigint") * F.lit(1 << 36)) + F.row_number().over(inside)).alias("row_id"),
    )

    # The last group of each range may go on in the next one: one row for each range.
    totals = spread.groupBy("_part", *group).agg(*[F.sum(f"_w_{n}").alias(n) for n in names])
    if group:
        last = Window.partitionBy("_part").orderBy(*[F.desc(name) for name in group])
        totals = totals.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    so_far = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = totals.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_c_part"),
        *[F.col(name).alias(f"_c_{name}") for name in group],
        *[F.sum(n).over(so_far).alias(f"_c_sum_{n}") for n in names],
    )
    same_group = F.col("_part") == F.col("_c_part")
    for name in group:
        same_group = same_group & F.col(name).eqNullSafe(F.col(f"_c_{name}"))
    joined = local.join(F.broadcast(carried), same_group, "left")
    return joined.select(
        *df.columns, "row_id", *[(F.col(n) + F.coalesce(f"_c_sum_{n}", F.lit(0))).alias(n) for n in names]
    )


#: Positions that one task sums in order.
BLOCK_BITS = 13


def prefix_sums(df: DataFrame, position: str, names: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names`` replaced by their sums over all positions up to the row's own.

    Positions are whole numbers from 0 without gaps, so blocks of them are of one size. Blocks are summed on their own,
    then blocks of blocks, and one row for each of these (2^26 positions) is ordered at the end.
    """

    def before(totals: DataFrame, key: str, within: Sequence[str], order: str) -> DataFrame:
        rows = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(key, *[F.coalesce(F.sum(n).over(rows), F.lit(0)).alias(f"_{key}_{n}") for n in names])

    placed = df.withColumn("_block", F.shiftright(position, BLOCK_BITS)).withColumn(
        "_super", F.shiftright("_block", BLOCK_BITS)
    )
    blocks = saved(placed.groupBy("_super", "_block").agg(*[F.sum(n).alias(n) for n in names]), "blocks")
    supers = blocks.groupBy("_super").agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.select(*[c for c in placed.columns if c not in names], *[F.sum(n).over(inside).alias(n) for n in names])
        .join(before(blocks, "_block", ["_super"], "_block"), "_block")
        .join(before(supers, "_super", [], "_super"), "_super")
        .select(
            *[c for c in df.columns if c not in names],
            *[(F.col(n) + F.col(f"__block_{n}") + F.col(f"__super_{n}")).alias(n) for n in names],
        )
    )


#: Rounds that shorten the list by a quarter each before pointers are doubled.
CONTRACTIONS = 6


def ranked(links: DataFrame) -> DataFrame:
    """List ranking: ``id`` and its ``position`` from 0 in the list that the pointers ``next`` make.

    ``links`` has whole numbers ``id``, unique, and ``next`` (NULL at the end of the one list), and ``home`` and ``seq``,
    which say where neighbours are likely: links of one home that follow each other in ``seq`` and in the list are first
    made one, by sorting small groups. Then, for some rounds, every element that drew 0 takes in its successor if that
    drew 1, so that all rounds together cost a constant times the list; the rest doubles its pointers, each round
    reaching twice as far. What was taken in gets its place from the element that took it, last round first. Every
    round is a join by unique keys, written to the shared folder.
    """
    home = Window.partitionBy("home").orderBy("seq")
    runs = saved(
        links.withColumn("opens", F.coalesce((F.lag("next").over(home) != F.col("id")).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("opens").over(home))
        .select("id", "next", "home", "run", "seq"),
        "runs",
    )
    run = ["home", "run"]
    heads = runs.groupBy(*run).agg(
        F.min_by("id", "seq").alias("id"), F.max_by("next", "seq").alias("next"), F.count("*").alias("length")
    )
    heads = saved(heads, "run-heads")
    left = heads.select("id", "next", "length")

    taken_in = []
    for number in range(CONTRACTIONS):
        # One that drew 0 meets its successor, if that drew 1, under the successor's id: one exchange, groups of two.
        taker = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(2)) == 0
        met = left.groupBy(F.when(taker, F.col("next")).otherwise(F.col("id")).alias("at")).agg(
            *[F.max(F.when(taker, F.col(name))).alias(name) for name in ("id", "length")],
            *[F.max(F.when(~taker, F.col(name))).alias(f"next_{name}") for name in ("id", "next", "length")],
        )
        met = saved(met, "contracted")
        both = "id is not null and next_id is not null"
        taken_in.append(met.filter(both).selectExpr("next_id as id", "id as by", "length as less"))
        left = met.selectExpr(
            "coalesce(id, next_id) as id",
            "if(next_id is null, at, next_next) as next",
            "coalesce(length, 0) + coalesce(next_length, 0) as length",
        )

    # ``length`` becomes the number of links from here to the end.
    while not left.filter("next is not null").isEmpty():
        ahead = left.select(
            F.col("id").alias("next"), F.col("next").alias("next_next"), F.col("length").alias("next_length")
        )
        left = saved(
            left.join(ahead, "next", "left").select(
                "id",
                F.col("next_next").alias("next"),
                (F.col("length") + F.coalesce("next_length", F.lit(0))).alias("length"),
            ),
            "doubled",
        )
    to_end = left.select("id", F.col("length").alias("to_end"))
    for inside in reversed(taken_in):
        known = to_end.withColumnRenamed("id", "by")
        placed = inside.join(known, "by").select("id", (F.col("to_end") - F.col("less")).alias("to_end"))
        to_end = saved(to_end.unionByName(placed), "placed")
    first = heads.join(to_end, "id").select(*run, "to_end")
    total = links.select(F.count("*")).scalar()
    place = F.row_number().over(Window.partitionBy(*run).orderBy("seq")) - F.lit(1)
    return runs.join(first, run).select("id", (total - F.col("to_end") + place).cast("bigint").alias("position"))

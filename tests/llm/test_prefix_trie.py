import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from typeflow.llm.ordered import prefix_sums, ranked, running
from typeflow.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie from dicts of tuples."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in talks.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        saves = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += saves
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if built[c] == node)
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed, convs=60, words=2):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(1, words))))
        for c in range(convs)
        for t in range(rng.randint(0, 14))
    ]


def test_trie_equals_brute_force(spark):
    rows = talks(1) + [(c, t, "user", "hello") for c in range(100, 180) for t in range(3)]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_ties_repeated_rows_negative_ids_and_clashing_columns(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (7, None, None, None), (7, 3, "user", "é" * 9), (7, 3, "user", "tie"), (7, 3, "user", "tie"),
        (5, 1, "user", "x"), (5, 2, "user", ""), (5, 2, None, "user"), (5, 4, "a", "b"),
        (-3, 1, "user", "x"), (-1, 1, "user", "x"), (0, 1, "user", "x"), (1, 1, "user", "x"), (2, 9, "", "x"),
        (-10, 1, "user", "y"), (-12, 1, "user", "z"), (-12, 1, "user", "z"), (2**62, 0, "user", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1L as id", "'x' as digest", "2L as row_id", "3L as depth", "'y' as _part", "0 as next", "0 as i"
    )
    assert found(conversation_trie(df)) == brute(rows)


def test_conversations_without_own_turns_left_end_at_the_root(spark):
    # An opening longer than the conversation, of a family head that isn't there: no turn is left.
    lone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "gone")]
    expected = [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == expected


def test_empty_table_has_no_nodes(spark):
    assert found(conversation_trie(spark.createDataFrame([], SCHEMA))) == []


def test_long_conversation_and_many_copies_of_one(spark):
    rows = [(1000, t, "user", str(t % 3)) for t in range(2500)]
    rows += [(c, t, "user", "same") for c in range(2000, 3500) for t in range(2)]
    got = found(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    # Sums over the long path by closed form; the rest is small enough to compare as it is.
    short = [(c, t, r, x) for c, t, r, x in rows if c != 1000]
    expected = {row[:2]: row for row in brute(short)}
    root = next(row for row in got if row[1] == 0)
    assert root[0] == 1000 and root[3] == 1501
    path = [row for row in got if row[0] == 1000 and row[1] > 0]
    assert len(path) == 2500 - (0 if 1000 % 5 == 0 else 9) and all(row[5] == 1 and row[6] == 0 for row in path)
    assert sorted(r for r in got if r[0] != 1000 and r[1] > 1) == sorted(r for r in expected.values() if r[1] > 1)


def test_running_sums_over_groups_cut_by_ranges(spark):
    rng = random.Random(3)
    rows = [(None if g == 3 else g, i, rng.randint(-5, 5)) for i in range(3000) for g in [rng.choice([0, 1, 1, 1, 1, 2, 3])]]
    df = spark.createDataFrame(rows, "g int, o int, w int")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = running(df, ["g"], ["o"], {"s": F.col("w"), "n": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums, counts = defaultdict(int), defaultdict(int)
    expected = {}
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        sums[g] += w
        counts[g] += 1
        expected[g, o] = (sums[g], counts[g])
    assert {(r.g, r.o): (r.s, r.n) for r in got} == expected
    assert len({r.row_id for r in got}) == len(rows)


@pytest.mark.parametrize("size", [1, 2, 700])
def test_list_ranks(spark, size):
    order = list(range(1, size + 1))
    random.Random(size).shuffle(order)
    rows = [(x, order[k + 1] if k + 1 < size else None, k // 7 % 5, k) for k, x in enumerate(order)]
    got = {r.id: r.position for r in ranked(spark.createDataFrame(rows, "id bigint, next bigint, home int, seq int")).collect()}
    assert got == {x: k for k, x in enumerate(order)}


def test_prefix_sums_across_blocks(spark):
    df = spark.range(20000).selectExpr("id as position", "id % 7 as w")
    got = {r.position: r.w for r in prefix_sums(df, "position", ["w"]).collect()}
    total = 0
    for k in range(20000):
        total += k % 7
        assert got[k] == total

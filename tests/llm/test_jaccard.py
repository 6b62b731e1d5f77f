"""The n-gram Jaccard join against a comparison of all pairs."""

import random

import numpy as np
import pytest

from typeflow.llm import common, jaccard


def shingle_set(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])


def by_all_pairs(rows, words, percent):
    sets = [shingle_set(text, words) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return sorted(
        ((d is None, d or 0), len(s), smallest.get(find(i), None) if s else d)
        for i, ((d, _), s) in enumerate(zip(rows, sets))
    )


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(6):
        other = list(base)
        for _ in range(rng.randint(0, edits)):
            other[rng.randrange(len(other))] = rng.choice(words)
        if rng.random() < 0.3:
            del other[rng.randrange(len(other)) :][:2]
        yield " ".join(other)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "of"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for size in (1, 3, 5, 12, 40, 90, 200, 600, 1500):
        texts += family(rng, words, size, max(1, size // 40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    texts += ["", None, "  ", "a b c d", "A  B\tc\nd", "same text of five words"] + ["copy of one text with words"] * 20
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_equal_those_of_all_pairs(documents, seed, words, percent):
    rows = corpus(seed)
    found = jaccard.joined(documents(rows, ["1 as key", "2 as n", "3 as h1"]), words, percent).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == by_all_pairs(rows, words, percent)


def test_clusters_in_many_tiles_give_the_same(documents, monkeypatch):
    rows = corpus(7)
    real = jaccard.tiles
    monkeypatch.setattr(jaccard, "tiles", lambda chosen, percent: real(chosen, percent, members=150, sets=4))
    monkeypatch.setattr(jaccard, "common_members", lambda docs, words: np.zeros(0, np.uint64))
    found = jaccard.joined(documents(rows), 4, 85).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == by_all_pairs(rows, 4, 85)


def test_linked_sets_show_a_part_in_common():
    rng, rule = np.random.default_rng(1), jaccard.Rule(85)
    for _ in range(400):
        size = int(rng.choice([1, 6, 30, 100, 130, 260, 700, 3000]))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.16], rng.integers(0, 2**64, int(rng.integers(0, size // 12 + 1)), dtype=np.uint64)]))
        common = np.sort(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
        both = len(np.intersect1d(a, b))
        shown, short = zip(*(rule.parts(s, common, frozenset()) for s in (a, b)))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not any(short):
            assert np.intersect1d(*shown).size


@pytest.mark.parametrize("percent", [85, 60, 30])
def test_sketches_of_linked_sets_differ_in_no_more_bits_than_the_sets_in_members(percent):
    rng, rule = np.random.default_rng(2), jaccard.Rule(percent)
    sets, base = [], None
    for k in range(120):
        if k % 3 == 0:
            base = rng.integers(0, 2**64, int(rng.choice([1, 6, 90, 700, 1023, 1025, 2100, 5000])), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.2], base[:1]])))
    n, keys = np.array([len(s) for s in sets]), np.arange(len(sets)) + 500
    sketches = [jaccard.sketch(s) for s in sets]

    def linked(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= percent * (n[i] + n[j] - both)

    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        root = {k: k for k in keys.tolist()}
        for a, b in jaccard._alike(keys, n, side, sketches, rule):
            root = {k: root[a] if r == root[b] else r for k, r in root.items()}
        two = len(set(side.tolist())) > 1
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j) and not (two and side[i] == side[j])]
        assert len(pairs) > 30 and all(root[keys[i]] == root[keys[j]] for i, j in pairs)
        assert len(set(root.values())) > 10 or percent < 85


def test_members_are_moved_for_sets_that_are_alike_only(documents, monkeypatch):
    """Short texts that meet in one cluster by chance parts, two of them alike."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 40))) for _ in range(300)]
    texts.append(texts[0] + " more")
    seen, real = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda docs, chosen, *more: seen.append(chosen.count()) or real(docs, chosen, *more))
    rows = [(i, t) for i, t in enumerate(texts)]
    found = jaccard.joined(documents(rows), 2, 85).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == by_all_pairs(rows, 2, 85)
    assert seen[0] < 20


def test_a_band_with_too_few_parts_is_shown_finer():
    rule, s = jaccard.Rule(85), np.arange(1, 701, dtype=np.uint64)  # all in one part
    shown, short = rule.parts(s, np.zeros(0, np.uint64), frozenset())
    assert short and len(rule.parts(s, np.zeros(0, np.uint64), frozenset(short))[0]) > rule.limit(2 * len(s))


def test_nulls_repeated_doc_ids_and_representatives(documents):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text), (3, "quite another text of some words"), (None, text), (None, None), (9, ""), (8, text + " eight")]
    docs = documents(rows, ["'x' as cluster"])
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.joined(docs, 5, 60).collect())
    assert found == [(0, 0, 0), (0, 3, 3), (3, 2, 3), (3, 3, 3), (5, 3, 3), (8, 4, 3), (9, 0, 9)]
    kept = jaccard.representatives(docs, 5, 60)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 3, 9]
    assert jaccard.joined(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["sorted chain", "alternating chain", "star", "random"])
def test_components_take_few_rounds(spark, monkeypatch, shape):
    size, rng = 10_000, random.Random(4)
    if shape == "sorted chain":
        edges = [(k, k + 1) for k in range(size)]
    elif shape == "alternating chain":
        order = [k // 2 if k % 2 else size - k // 2 for k in range(size)]
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(size // 2, k) for k in range(size)]
    else:
        edges = [(rng.randrange(size), rng.randrange(size)) for _ in range(size // 2)]
    written = []
    real = common.saved
    monkeypatch.setattr(common, "saved", lambda df, name: written.append(name) or real(df, name))
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    lowest = {node: node for edge in edges for node in edge}

    def root(node):
        while lowest[node] != node:
            lowest[node] = lowest[lowest[node]]
            node = lowest[node]
        return node

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        lowest[high] = low
    assert found == {node: root(node) for node in lowest}
    assert written.count("edges") - 1 <= 20


def test_common_members_are_the_same_whatever_the_batches(spark, documents):
    rng = random.Random(20)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs = documents([words(6) + (" one line that some documents have" if i % 50 == 0 else "") for i in range(1000)]).coalesce(1)
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for rows in (10_000, 70):
            spark.conf.set(key, str(rows))
            found.append(jaccard.common_members(docs, 4, 0.02).tolist())
    finally:
        spark.conf.set(key, before)
    assert len(found[0]) == 3 and found[0] == found[1]

"""Line dedup: passages planted in texts, and what has to stay."""

import random

from pyspark.sql import functions as F

from typeflow.llm import line_dedup


def prose(rng, words, capital=True):
    out = []
    while len(out) < words:
        n = rng.randint(3, 14)
        out += [f"{rng.choice('bcdfgh')}{rng.randrange(10**6)}" for _ in range(n)]
        out[-n], out[-1] = out[-n].capitalize(), out[-1] + rng.choice([".", ".", "!", ".\n"]).strip(" ")
    return " ".join(out).replace("\n ", "\n")


def kept(documents, rows):
    return {r.doc_id: r for r in line_dedup.marked(documents(rows, ["'x' as kept", "1 as w"])).collect()}


def test_planted_passages_are_cut_from_later_documents(documents):
    rng = random.Random(1)
    passages = [prose(rng, 55) for _ in range(6)]
    rows, planted = [], []
    for i in range(60):
        text = prose(rng, rng.choice([40, 200, 600]))
        if i % 3 == 0:
            passage, at = passages[i % len(passages)], rng.randrange(len(text.split(" ")))
            words = text.split(" ")
            text = " ".join(words[:at] + [passage.strip()] + words[at:])
            planted.append((i, passage))
        rows.append((i, text))
    found = kept(documents, rows)
    seen = set()
    for i, passage in planted:
        middle = " ".join(passage.split()[15:35])
        whole = " ".join(found[i].kept.split())
        assert (middle in whole) == (passage not in seen)
        seen.add(passage)
    clean = [i for i in range(60) if i % 3]
    assert all(found[i].removed_lines == 0 and found[i].kept == rows[i][1] for i in clean)


def test_lines_make_up_the_text(spark, documents):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["Ab", "c ", "\n", ". ", "D", "é", " Ü", "!!", "\t", " Xy "]) for _ in range(30)) for _ in range(200)]
    rows = documents(texts).select("text", line_dedup.lines(F.col("text")).alias("l")).collect()
    assert all("".join(r.l) == r.text for r in rows)


def test_copies_go_and_the_first_stays(documents):
    rng = random.Random(3)
    text, other = prose(rng, 120), prose(rng, 100)
    docs = documents([(7, text), (2, text), (9, other), (4, None), (5, ""), (None, text), (2, text)])
    found = line_dedup.marked(docs).collect()
    assert {(r.doc_id, r.removed_lines > 0) for r in found} == {(2, False), (4, False), (5, False), (7, True), (9, False), (None, True)}
    left = line_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(2, text), (2, text), (9, other)]
    assert {r.doc_id for r in left.collect() if not r.text} == {4, 5}
    assert line_dedup.marked(docs.limit(0)).count() == 0


def test_short_common_lines_stay(documents):
    rng = random.Random(4)
    head, tail = "A header of the site that all pages have. ", " All rights reserved by someone."
    rows = [(i, head + prose(rng, 80) + tail) for i in range(30)]
    assert all(r.removed_lines == 0 for r in kept(documents, rows).values())


def test_repeated_lines_inside_a_document(documents):
    rng = random.Random(5)
    block = prose(rng, 16)
    text = prose(rng, 50) + "\n" + "\n".join(["Menu item one of the site.", "Second line of the menu."] * 20) + "\n" + block
    r = kept(documents, [(1, text)])[1]
    assert r.removed_lines > 30 and "Menu item one" in r.kept and block.split()[5] in r.kept


def test_short_lines_in_long_runs(documents):
    rng = random.Random(6)
    shared = "\n".join(f"Item{rng.randrange(10**6)} x" for _ in range(60))
    rows = [(i, prose(rng, 60) + "\n" + shared + "\n" + prose(rng, 60)) for i in range(4)]
    found = kept(documents, rows)
    assert found[0].removed_lines == 0 and all(found[i].removed_lines >= 55 for i in (1, 2, 3))


def test_every_copy_of_an_earlier_passage_goes(documents):
    rng = random.Random(7)
    lines = [f"Line{i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for i in range(12)]
    # The second copy has two lines less, the third one begins later: each has an offset of its own.
    copies = [lines, lines[:10], lines[2:]]
    later = "\n".join(x for c in copies for x in [prose(rng, 80), *c]) + "\n" + prose(rng, 80)
    found = kept(documents, [(1, "\n".join(lines)), (2, later)])
    assert found[1].removed_lines == 0
    assert not any(x.split()[0] in found[2].kept for x in lines)
    assert found[2].removed_lines == sum(map(len, copies))


def test_repetition_at_any_distance_inside_a_document(documents):
    rng = random.Random(8)
    line = lambda i: f"Line{i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    block, long = [line(i) for i in range(6)], "Long " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    text = [*block, *map(line, range(100, 120)), long, *block, line(200), *block[1:5], line(201), long, *block[:3], line(202)]
    found = kept(documents, [(1, "\n".join(text)), (2, "\n".join(map(line, range(300, 340))))])
    # Three lines of the block are 27 words and stay; the long line takes them along where it stands before them.
    taken = [False] * 27 + [True] * 6 + [False] + [True] * 4 + [False] + [True] * 4 + [False]
    assert found[1].kept.split("\n") == [x for x, t in zip(text, taken) if not t] and found[2].removed_lines == 0


def test_repetition_inside_documents_against_brute_force(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for doc in range(300):
        n, kinds = rng.randrange(0, 50), rng.choice([2, 6, 30])
        words = [rng.choice([1, 4, 9, 35]) for _ in range(kinds)]
        h = [rng.randrange(kinds) for _ in range(n)]
        cut = set()
        for p in range(1, n):
            at = p
            while at < n:
                end = at
                while end < n and h[end] == h[end - p]:
                    end += 1
                if sum(words[x] for x in h[at:end]) >= line_dedup.RUN:
                    cut |= set(range(at, end))
                at = end + 1
        rows.append((doc, 0, h, [words[x] for x in h]))
        expected[doc] = cut
    made = spark.createDataFrame(rows, "doc_id bigint, mark bigint, h array<bigint>, w array<int>")
    found = {r.doc_id: {i for x in r.runs for i in range(x.start, x.end)} for r in line_dedup.within(made).collect() if r.runs}
    assert sum(map(bool, expected.values())) > 100
    assert found == {doc: cut for doc, cut in expected.items() if cut}


def maximal_runs(a, b):
    """(start in a, end in a) of the longest common runs of lines along every offset."""
    for offset in range(1 - len(a), len(b)):
        start = None
        for i in range(max(0, -offset), min(len(a), len(b) - offset) + 1):
            same = i < min(len(a), len(b) - offset) and a[i] == b[i + offset]
            if same and start is None:
                start = i
            elif not same and start is not None:
                yield start, i
                start = None


def test_runs_between_documents_against_brute_force(documents):
    """Passages are cut anew for every document, so the parts of a run were first seen in different documents."""
    rng = random.Random(10)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 9, 19, 35]))) for _ in range(150)]
    size = {x: len(x.split()) for x in base}
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(base))
            parts += base[at : at + rng.randint(1, 9)] + [f"own{rng.randrange(10**9)} line"] * rng.randint(0, 1)
        texts.append(parts)
        size |= {x: len(x.split()) for x in parts}
    found = {r.doc_id: r.runs for r in line_dedup.repeated(documents(["\n".join(x) for x in texts])).collect()}
    words, seen, whole, in_part = lambda lines: sum(size[x] for x in lines), set(), 0, 0
    for d, mine in enumerate(texts):
        gone = {i for run in found.get(d, []) for i in range(run.start, run.end)}
        allowed = {i for i in range(1, len(mine)) if mine[i] in mine[:i]}
        for e in range(d):
            for start, end in maximal_runs(mine, texts[e]):
                if words(mine[start:end]) >= line_dedup.RUN:
                    allowed |= set(range(start, end))
                if words(mine[start:end]) > 50:
                    lines = set(mine[start:end])
                    if not any(lines & set(texts[f]) for f in range(e)):  # no part of it was seen before
                        whole += 1
                        assert gone >= set(range(start, end)), (d, e, start, end)
                    else:
                        in_part += words(mine[i] for i in set(range(start, end)) - gone)
                        seen |= {(d, i) for i in range(start, end)}
        assert gone <= allowed
    # Of runs whose parts were first seen in different documents few words stay.
    assert whole > 20 and in_part < 0.1 * sum(size[texts[d][i]] for d, i in seen)


def test_a_long_document_and_one_long_line(documents):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(6000)]
    one = " ".join(f"v{rng.randrange(10**6)}" for _ in range(20_000))
    rows = [(1, "\n".join(lines)), (2, "\n".join(["head of the second"] + lines[100:5900])), (3, one), (4, "head\n" + one), (5, "\n".join(lines[50:60]))]
    found = kept(documents, rows)
    assert found[1].removed_lines == found[3].removed_lines == 0
    assert found[2].removed_lines == 5800 and found[4].kept == "head\n" and found[5].kept == ""


def test_stretches_are_made_of_repeated_lines_only(documents):
    rng = random.Random(11)
    one, other = [f"{prose(rng, 10).strip()}\n" for _ in range(6)], [f"{prose(rng, 10).strip()}\n" for _ in range(200)]
    text = "".join(one + other + one)
    rows = line_dedup.hashed(documents([(1, text)]))
    line = rows.first()
    twice = rows.select(line_dedup._twice(F.col("h"))).first()[0]
    assert twice == [line.h.count(x) > 1 for x in line.h]
    words = F.zip_with("w", line_dedup._twice(F.col("h")), lambda n, is_twice: F.when(is_twice, n))
    found = rows.select(line_dedup._stretches(F.col("h"), words, 1).alias("s")).first().s
    expected = []
    for i in range(len(twice)):
        ends = [n for n in range(1, len(twice) - i + 1) if sum(line.w[i : i + n]) >= line_dedup.RUN]
        if ends and all(twice[i : i + ends[0]]):
            expected.append((i, ends[0]))
    assert [(x.at, x.n) for x in found] == expected
    assert 0 < len(found) < 40


def test_lines_end_without_any_white_space(documents):
    rng = random.Random(12)
    texts = [prose(rng, 8) + "".join(rng.choice(" \t\r\f\x0b\n") for _ in range(rng.randint(0, 6))) for _ in range(80)]
    docs = documents(list(enumerate(texts)))
    found = docs.select("text", F.transform(line_dedup.lines(F.col("text")), line_dedup._trimmed).alias("l"), line_dedup.lines(F.col("text")).alias("whole"))
    for r in found.collect():
        assert list(r.l) == [x.rstrip(" \t\r\n\f\x0b") for x in r.whole]


def test_lines_are_cut_where_they_were(documents):
    before = r"(?<=\n)(?=\S)|(?<=[.!?]\s)(?=\S)|(?<= )(?=\p{Lu}\p{Ll})"
    rng = random.Random(13)
    signs = ["Ab", "b", "Üb", "É", ".", "!", "?", " ", "\n", "\t", "\r", "\x0b", "\xa0", "中"]
    docs = documents(["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)])
    found = docs.select(F.split("text", before, -1).alias("old"), F.split("text", line_dedup.CUT, -1).alias("new")).collect()
    assert all(r.old == r.new for r in found) and sum(len(r.old) > 3 for r in found) > 100


def test_periodic_documents_against_brute_force(spark):
    """Blocks repeated many times, with breaks, other blocks and parts of the block around them."""
    rng = random.Random(14)
    rows, expected, most, left = [], {}, 0, 0
    for doc in range(120):
        sizes = [rng.choice([1, 1, 2, 5]) for _ in range(40)]
        block = [rng.randrange(40) for _ in range(rng.randint(1, 25))]
        h = [rng.randrange(40) for _ in range(rng.randrange(30))]
        for _ in range(rng.randint(1, 3)):
            h += block * rng.randint(3, 15) + block[: rng.randrange(len(block))]
            h += rng.choice([[], [rng.randrange(40) for _ in range(rng.randrange(20))], h[: rng.randrange(40)]])
        cut = set()
        for p in range(1, len(h)):
            at = p
            while at < len(h):
                end = at
                while end < len(h) and h[end] == h[end - p]:
                    end += 1
                if sum(sizes[x] for x in h[at:end]) >= line_dedup.RUN:
                    cut |= set(range(at, end))
                at = end + 1
        # Hashes are spread; in some documents all have the same upper half.
        spread = [rng.getrandbits(63) for _ in range(40)] if doc % 4 else range(40)
        rows.append((doc, 0, [spread[x] for x in h], [sizes[x] for x in h]))
        expected[doc] = cut
    made = spark.createDataFrame(rows, "doc_id bigint, mark bigint, h array<bigint>, w array<int>")
    found = {r.doc_id: {i for x in r.runs for i in range(x.start, x.end)} for r in line_dedup.within(made).collect() if r.runs}
    assert found == {doc: cut for doc, cut in expected.items() if cut}
    usual = made.select("h", line_dedup._usual_runs(F.col("h"), F.col("w")).alias("u"))
    rest = usual.select(F.size("h").alias("n"), line_dedup._without_inside(F.col("h"), F.col("h"), F.col("u"))["at"].alias("at"))
    for r in rest.collect():
        most, left = most + r.n, left + len(r.at)
    assert left < 0.8 * most


def test_each_line_of_a_pair_is_compared_once(documents):
    """The plan compares the lines of two documents in one place; they were compared six times for each offset."""
    rows = documents([(1, "a b c"), (2, "d e f")])
    made = rows.select(F.array(F.lit(1), F.lit(2)).alias("h"), F.array(F.lit(1), F.lit(3)).alias("met"), F.lit(0).alias("low"), F.array(F.lit(40), F.lit(40)).alias("w"))
    expression = made.select(line_dedup._runs(F.col("h"), F.col("low"), F.col("met"), F.col("w")).alias("r"))
    assert expression._jdf.queryExecution().analyzed().toString().count("get(h") == 1
    assert [tuple(x) for x in expression.first().r] == [(0, 1)]

"""Removal of passages that an earlier document has already, in DataFrame operations alone.

A text is cut into lines: at line breaks, after sentences and before words with a capital letter, so that a passage put
anywhere into a text keeps its lines. Two lines in a row are hashed as one gram; winnowing selects, of every ``WINDOW``
grams in a row, the smaller one, and a line of ``LONG`` words or more is a gram by itself that is always selected.
Where two lines have less than ``LEAST`` words, grams of ``MANY`` lines take their place. So a run of more than 50
words, in whole lines, that two documents share has a selected gram in both: it has a long line, or three lines and
with them a window of two grams, or many short lines.

The positions of selected grams are joined to the first position, in the first document, that has each. The difference
of the two positions is an offset between a later and an earlier document; along each offset their line hashes are
compared, which extends matches both ways, and runs of at least ``RUN`` words are deleted from the later document. Of
the earlier document only the lines that the later one can meet at that offset are moved. Where the parts of a run were
first seen in different documents, each part is compared with its own, and lines between them can stay.

Inside a document, a run of at least ``RUN`` words that stands earlier in it is found exactly, at any distance: such a run
is made up of the shortest stretches of ``RUN`` words that begin, or end, at each of its lines, and a stretch whose hash
an earlier one has is deleted. Of documents that repeat one block over and over only stretches at the ends of the
repetition are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import saved

#: Between two lines; nothing is taken away, so the lines make up the text again. What all cuts have in common comes first:
#: it rules out most places at once.
CUT = r"(?<=\s)(?=\S)(?:(?<=\n)|(?<=[.!?]\s)|(?<= )(?=\p{Lu}\p{Ll}))"
WINDOW = 2
LONG = 20
#: Two lines of fewer words are found in texts that have nothing else in common.
LEAST, MANY = 8, 8
RUN = 30
RUNS = "array<struct<start:int,end:int>>"


def lines(text: Column) -> Column:
    return F.filter(F.split(text, CUT, -1), lambda x: x != "")


def _trimmed(x: Column) -> Column:
    """A line without white space at its end; most lines end in spaces, which are cut from the end alone."""
    spaceless = F.rtrim(x)
    more = F.lit(False)
    for other in "\n\r\t\f\x0b":
        more = more | F.endswith(spaceless, F.lit(other))
    return F.when(more, F.rtrim(x, F.lit(" \t\r\n\f\x0b"))).otherwise(spaceless)


def hashed(docs: DataFrame) -> DataFrame:
    """Of each row: ``doc_id``, ``mark`` (a hash of the text), the hashes ``h`` of its lines and their words ``w``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), lines(text).alias("l"))
    rows = rows.select("doc_id", "mark", F.transform("l", _trimmed).alias("l"))
    words = F.transform("l", lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    return rows.select("doc_id", "mark", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), words.alias("w"))


def _next_to(x: Column, f) -> Column:
    """``f`` of every two neighbours in an array."""
    size = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, F.lit(2), size), f)


def _once(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once, however often ``f`` uses it and also where it does so for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _least_of(x: Column, i: Column, size: int) -> Column:
    """The place of the smallest of ``size`` elements from ``i`` on; null if all are null."""
    best, value = i, F.get(x, i)
    for k in range(1, size):
        other = F.get(x, i + k)
        closer = other.isNotNull() & (value.isNull() | (other < value))
        best, value = F.when(closer, i + k).otherwise(best), F.least(value, other)
    return F.when(value.isNotNull(), best)


def _selected(x: Column, size: int) -> Column:
    """The places of the smallest element in every window of ``size``, each once."""
    windows = F.slice(x, F.lit(1), F.greatest(F.size(x) - (size - 1), F.lit(0)))
    return F.array_distinct(F.array_compact(F.transform(windows, lambda _, i: _least_of(x, i, size))))


def fingerprints(rows: DataFrame) -> DataFrame:
    """The selected grams of each row, with the line each begins at (``at``) and the row's lines (``n_lines``). They are
    chosen inside the row, so no text or line is moved."""
    h, w = F.col("h"), F.col("w")
    two_words = _next_to(w, lambda a, b: a + b)
    rows = rows.withColumn("two_words", two_words)
    two = F.zip_with(_next_to(h, lambda a, b: F.xxhash64(a, b)), "two_words", lambda g, n: F.when(n >= LEAST, g))
    places = F.filter(F.sequence(F.lit(0), F.size(h) - MANY), lambda i: F.get("two_words", i) < LEAST)
    many_at = F.when(F.size(h) >= MANY, places).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "mark", "h", "w", two.alias("two"), many_at.alias("many_at"))
    rows = rows.withColumn("many", F.transform("many_at", lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(MANY)])))

    def marked_at(gram: Column, at: Column) -> Column:
        return F.struct(gram.alias("gram"), at.alias("at"))

    alone = F.transform("two", lambda g, i: F.when(g.isNotNull(), i))
    least = F.when(F.size("two") < WINDOW, F.array_compact(alone)).otherwise(_selected(F.col("two"), WINDOW))
    long = F.array_compact(F.transform(w, lambda n, i: F.when(n >= LONG, i)))
    chosen = F.concat(
        F.transform(least, lambda i: marked_at(F.get("two", i), i)),
        F.transform(long, lambda i: marked_at(F.xxhash64(F.get("h", i), F.lit(1)), i)),
        F.transform(_selected(F.col("many"), 3), lambda j: marked_at(F.get("many", j), F.get("many_at", j))),
    )
    rows = rows.select("doc_id", "mark", F.size("w").alias("n_lines"), chosen.alias("grams"))
    return rows.select("doc_id", "mark", "n_lines", F.explode_outer("grams").alias("chosen")).filter(
        "chosen is not null"  # explode would have all of the above evaluated once more, to filter it
    ).select("doc_id", "mark", "n_lines", "chosen.*")


def _place() -> Column:
    """Order of documents: by doc_id, nulls last; texts of one doc_id by their hash."""
    parts = [F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("mark")]
    return F.struct(*parts)


def matches(rows: DataFrame) -> DataFrame:
    """A later document (and its ``n_lines``), an earlier one that was the first to have some of its grams, and the
    ``offsets`` between these grams' positions: a line of the earlier one is that many behind the later one's."""
    marks = saved(fingerprints(rows), "grams")
    place = F.struct(_place().alias("place"), "at")
    firsts = marks.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # A stored table on both sides of the join lets adaptive execution split a gram that many documents have.
    firsts = saved(firsts.filter("n > 1").select("gram", "first"), "firsts")
    found = marks.join(firsts, "gram").filter(_place() > F.col("first.place"))
    return found.groupBy(
        "doc_id", "mark", "n_lines", F.col("first.place.doc_id").alias("from_id"), F.col("first.place.mark").alias("from_mark")
    ).agg(F.collect_set(F.col("first.at") - F.col("at")).alias("offsets"))


def _runs(h: Column, low: Column, met: Column, w: Column) -> Column:
    """The runs of lines, from line ``low`` on, that are those of ``met``, as (start, end), ends exclusive, that have
    ``RUN`` words or more; ``w`` has the words of each line, one at least, so ``RUN`` lines needn't be counted."""
    words = lambda x: F.aggregate(F.slice(w, x["start"] + 1, x["end"] - x["start"]), F.lit(0), lambda n, v: n + v)

    def between(ends):
        runs = _next_to(ends, lambda a, b: F.when(b > a + 1, F.struct((a + 1).alias("start"), b.alias("end"))))
        return F.filter(runs, lambda x: x.isNotNull() & ((x["end"] - x["start"] >= RUN) | (words(x) >= RUN)))

    differs = F.array_compact(F.transform(met, lambda x, i: F.when(x != F.get(h, low + i), low + i)))
    return _once(F.concat(F.array(low - 1), differs, F.array(low + F.size(met))), between)


def _twice(h: Column) -> Column:
    """Of each line whether the document has it elsewhere too."""

    def marked(s):
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        found = F.transform(s, lambda x, k: F.struct(x["at"].alias("at"), (same(x, k - 1) | same(x, k + 1)).alias("twice")))
        return F.transform(F.sort_array(found), lambda x: x["twice"])

    return _once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), marked)


def _stretches(h: Column, w: Column, way: int) -> Column:
    """(hash, at, n): for each line the ``n`` lines from it on (``way`` 1) or up to it (-1) that are the fewest with ``RUN``
    words, ``at`` being the first; none where there are fewer words before the document ends or a line has none (null
    in ``w``). They are read off the line numbers of all words, of ``RUN`` words of a line at most."""
    words = F.flatten(F.transform(w, lambda n, i: F.array_repeat(F.when(n.isNotNull(), i), F.least(n, F.lit(RUN)))))

    def ends(x):
        first = lambda line, k: line.isNotNull() & ~line.eqNullSafe(F.get(x, k - way))
        other = lambda k: F.get(x, k + way * (RUN - 1)).alias("other")
        both = F.transform(x, lambda line, k: F.when(first(line, k), F.struct(line.alias("line"), other(k))))
        return F.filter(both, lambda s: s["other"].isNotNull())

    def stretch(s):
        at = s["line"] if way > 0 else s["other"]
        n = (s["other"] - s["line"]) * way + 1
        return F.struct(F.xxhash64(F.slice(h, at + 1, n), F.lit(way)).alias("hash"), at.alias("at"), n.alias("n"))

    return F.transform(_once(words, ends), stretch)


def _repeated_words(h: Column, w: Column) -> Column:
    """The most words that lines in a row have, each of which the document has elsewhere too."""

    def places(s):
        twice = _next_to(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(twice))))

    def step(acc, at):
        words = F.get(w, at) + F.when(at == acc["at"] + 1, acc["words"]).otherwise(0)
        return F.struct(at.alias("at"), words.alias("words"), F.greatest(acc["most"], words).alias("most"))

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("words"), F.lit(0).alias("most"))
    return F.aggregate(_once(ordered, places), start, step, lambda acc: acc["most"])


def _usual_distance(h: Column) -> Column:
    """The median of the distances from a line to the next one like it (by half of their hashes); null without any."""
    placed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i)))
    alike = lambda a, b: F.shiftright(a.bitwiseXOR(b), 32) == 0
    apart = _once(placed, lambda s: F.array_compact(_next_to(s, lambda a, b: F.when(alike(a, b), (b - a).cast("int")))))
    return _once(F.sort_array(apart), lambda s: F.get(s, F.shiftright(F.size(s), 1)))


def _usual_runs(h: Column, w: Column) -> Column:
    """The runs of lines that stand one usual distance earlier as well."""
    return _once(
        _usual_distance(h), lambda p: F.coalesce(_runs(h, p, F.slice(h, F.lit(1), F.size(h) - p), w), F.array().cast(RUNS))
    )


def _without_inside(h: Column, w: Column, runs: Column) -> Column:
    """``h``, ``w`` and line numbers ``at`` of the lines that aren't ``RUN`` lines inside one of ``runs``; of the lines left
    out the first stays, with a hash of its own, so that what is on both sides stays apart."""
    inside = F.transform(
        F.filter(runs, lambda x: x["end"] - x["start"] > 2 * RUN),
        lambda x: F.struct((x["start"] + RUN).alias("start"), (x["end"] - RUN).alias("end")),
    )

    def others(inside):
        begin = F.concat(F.array(F.lit(0)), F.transform(inside, lambda x: x["end"]))
        end = F.concat(F.transform(inside, lambda x: x["start"]), F.array(F.size(h) - 1))
        return F.flatten(F.zip_with(begin, end, lambda a, b: F.sequence(a, b)))

    def lines_at(inside, at):
        own = lambda i: F.exists(inside, lambda x: x["start"] == i)
        hashes = F.transform(at, lambda i: F.when(own(i), F.xxhash64(i, F.lit("left out"))).otherwise(F.get(h, i)))
        return F.struct(hashes.alias("h"), F.transform(at, lambda i: F.get(w, i)).alias("w"), at.alias("at"))

    return _once(inside, lambda x: _once(others(x), lambda at: lines_at(x, at)))


def _repeats(h: Column, w: Column, line: Column) -> Column:
    """The runs of lines that repeat earlier ones, by stretches; ``line`` has the lines' numbers."""
    none = F.array().cast(RUNS)

    def later(s):
        """The stretches whose hash one before them has, in order."""
        end = lambda x: F.get(line, x["at"] + x["n"] - 1) + 1
        return F.sort_array(F.array_compact(_next_to(s, lambda a, b: F.when(
            a["hash"] == b["hash"], F.struct(F.get(line, b["at"]).alias("start"), end(b).alias("end"))
        ))))

    def step(acc, x):
        done, apart = F.struct(acc["start"].alias("start"), acc["end"].alias("end")), x["start"] > acc["end"]
        return F.struct(
            F.when(apart, x["start"]).otherwise(acc["start"]).alias("start"),
            F.greatest(acc["end"], x["end"]).alias("end"),
            F.when(apart, F.array_append(acc["runs"], done)).otherwise(acc["runs"]).alias("runs"),
        )

    def united(found):
        first = F.get(found, F.lit(0))
        start = F.struct(first["start"].alias("start"), first["end"].alias("end"), none.alias("runs"))
        runs = F.aggregate(
            found, start, step,
            lambda acc: F.array_append(acc["runs"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"))),
        )
        return F.when(F.size(found) > 0, runs)

    # Every line of a stretch that stands twice is there twice; lines that aren't have no words here.
    words = F.zip_with(w, _twice(h), lambda n, twice: F.when(twice, n))
    stretches = _once(words, lambda w: F.concat(_stretches(h, w, 1), _stretches(h, w, -1)))
    return _once(F.sort_array(F.array_compact(stretches)), lambda s: _once(later(s), united))


def _may_repeat(h: Column, w: Column) -> Column:
    """False where a document has no words enough in repeated lines."""
    return (F.size(h) - F.size(F.array_distinct(h))) * F.array_max(w) >= RUN


def within(rows: DataFrame) -> DataFrame:
    """The runs of lines of each document that repeat earlier lines of it: ``doc_id``, ``mark``, ``runs`` (they may overlap).

    Long repetition is mostly of one block over and over, so the runs at the usual distance between like lines are
    taken first. A stretch inside such a run is deleted, and what it repeats stands a distance earlier too, and
    so on until before the run: so stretches that reach out of these runs are compared among themselves, and lines
    farther inside than a stretch is long are left out.
    """
    h, w = F.col("h"), F.col("w")

    def others(usual):
        rest = _without_inside(h, w, usual)
        may = lambda s: _may_repeat(s["h"], s["w"]) & (_repeated_words(s["h"], s["w"]) >= RUN)
        return _once(rest, lambda s: F.when(may(s), _repeats(s["h"], s["w"], s["at"])))

    runs = _once(_usual_runs(h, w), lambda usual: F.concat(usual, F.coalesce(others(usual), F.array().cast(RUNS))))
    return rows.filter(_may_repeat(h, w)).select("doc_id", "mark", runs.alias("runs"))


def repeated(docs: DataFrame) -> DataFrame:
    """Of each document that repeats something: ``doc_id``, ``mark`` and ``runs``, the runs of lines to delete."""
    rows = saved(hashed(docs), "lines")
    pairs = matches(rows)
    theirs = rows.select(F.col("doc_id").alias("from_id"), F.col("mark").alias("from_mark"), F.col("h").alias("from_h"))
    both = pairs.join(
        theirs, pairs["from_id"].eqNullSafe(theirs["from_id"]) & (pairs["from_mark"] == theirs["from_mark"])
    ).select("doc_id", "mark", "n_lines", "from_h", F.explode("offsets").alias("offset"))
    low = F.greatest(F.lit(0), -F.col("offset"))
    high = F.least(F.col("n_lines"), F.size("from_h") - F.col("offset"))
    met = both.select("doc_id", "mark", low.alias("low"), F.slice("from_h", low + F.col("offset") + 1, high - low).alias("met"))
    mine = rows.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "h", "w")
    along = met.join(mine, met["doc_id"].eqNullSafe(mine["own_id"]) & (met["mark"] == mine["own_mark"]))
    across = along.select("doc_id", "mark", _runs(F.col("h"), F.col("low"), F.col("met"), F.col("w")).alias("runs"))
    return (
        across.unionByName(within(rows))
        .select("doc_id", "mark", F.explode_outer("runs").alias("run"))
        .filter("run is not null")
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_set("run")).alias("runs"))
    )


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept``, the text without repeated passages (null for null texts), and ``removed_lines``.

    A run counts as repeated if a document with a smaller doc_id has it (nulls last; among texts of one doc_id, by the
    text's hash), and is deleted where it has ``RUN`` words or more. Rows repeated with doc_id and text are one
    document and stay alike. Empty texts have no lines. Texts are compared whole, and further columns come back; own
    columns named like the new ones, or beginning with an underscore, are replaced.
    """
    docs = docs.select([c for c in docs.columns if not c.startswith("_") and c not in ("kept", "removed_lines")])
    found = repeated(docs.select("doc_id", "text"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("runs").alias("_runs"))
    keyed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = keyed.join(
        found, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left"
    )
    has = F.col("_runs").isNotNull()
    rows = rows.withColumn("_lines", F.when(has, lines(F.col("text"))))
    left = F.filter("_lines", lambda x, i: ~F.exists("_runs", lambda r: (i >= r["start"]) & (i < r["end"])))
    rows = rows.withColumn("_left", F.when(has, left))
    return (
        rows.withColumn("kept", F.when(has, F.array_join("_left", "")).otherwise(F.col("text")))
        .withColumn("removed_lines", F.when(has, F.size("_lines") - F.size("_left")).otherwise(F.lit(0)))
        .drop("_lines", "_left", "_runs", "_mark", "_id", "_hash")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, without repeated passages; a document of which nothing is left is dropped.

    Texts that were empty before stay, and ``n_chars`` follows the text where there is such a column.
    """
    found = marked(docs)
    emptied = (F.col("removed_lines") > 0) & (F.length(F.trim(F.translate("kept", "\n\r\t", "   "))) == 0)
    changed = F.col("removed_lines") > 0
    out = found.filter(~emptied)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast(kind))
    return out.withColumn("text", F.col("kept")).select(*docs.columns)

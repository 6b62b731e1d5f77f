"""Secrets in texts, told apart by how many owners have them. DataFrame operations alone.

Fixed patterns find assignments, access keys and hex strings; long opaque tokens that none of them covers are further
candidates. Every candidate value is hashed, and its hash is counted over the whole corpus by distinct repositories and
owners. A value that many owners or many repositories have, or that looks like a placeholder, is an example that people
copy; a value that stays with one or two owners, in few repositories, is a credential that looks live. Opaque tokens are
reported only if they look live. Only hashes leave the task that read a text; values aren't stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import saved

# The patterns of each kind, in the order in which kinds are listed. All are greedy up to the end of a run,
# so a least length inside the pattern finds the same as dropping shorter matches; in the first one, it is checked after.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
ASSIGN_LEAST = 6
#: A value of more owners, or in more repositories, than this is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
#: What an opaque token needs besides its length.
LEAST_DIGITS, LEAST_LETTERS, LEAST_DIFFERENT = 4, 4, 10
MASK = "[SECRET]"


def looks_like_placeholder(value: Column) -> Column:
    """Values that say what they are: words for examples, or a short run repeated."""
    words = value.rlike("(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|<|1234567|abcdefg")
    return words | value.rlike(r"^(.{1,4})\1+.{0,3}$")


def _matches(text: Column, pattern: str, kind: str, value_group: int, keep) -> Column:
    """The matches of one kind: start, order of its kind, end, kind, where its value starts, the value's hash.

    ``split`` gives the text between the matches, so positions are sums of lengths, in code points.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    zipped = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value")
    )
    none = F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string,value_at:int,hash:string,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_at"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            (end - F.length(x["value"])).alias("value_at"),
            F.sha2(x["value"], 256).alias("hash"),
            x["value"].alias("value"),
        )
        return F.struct(end.alias("at"), F.array_append(acc["found"], found).alias("found"))

    walked = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    names = ("start", "kind_at", "end", "kind", "value_at", "hash")
    hashed = F.transform(
        F.filter(walked, keep),
        lambda x: F.struct(*[x[n].alias(n) for n in names], looks_like_placeholder(x["value"]).alias("placeholder")),
    )
    return F.when(text.rlike(pattern), hashed).otherwise(
        F.array().cast("array<struct<start:int,kind_at:int,end:int,kind:string,value_at:int,hash:string,placeholder:boolean>>")
    )


def _opaque(x: Column) -> Column:
    digits = F.length(F.regexp_replace(x["value"], "[^0-9]", ""))
    letters = F.length(F.regexp_replace(x["value"], "[^A-Za-z]", ""))
    different = F.size(F.array_distinct(F.split(x["value"], "")))
    return (digits >= LEAST_DIGITS) & (letters >= LEAST_LETTERS) & (different >= LEAST_DIFFERENT)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (the spans of the fixed patterns) and ``_more`` (opaque tokens beside them)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(
        _matches(text, ASSIGN, "assign", 2, lambda x: F.length(x["value"]) >= ASSIGN_LEAST),
        _matches(text, ACCESS, "access", 0, lambda x: F.lit(True)),
        _matches(text, HEX, "hex", 0, lambda x: F.lit(True)),
    )
    found = docs.withColumn("_base", F.array_sort(base)).withColumn("_tokens", _matches(text, OPAQUE, "opaque", 0, _opaque))
    apart = F.filter(
        "_tokens", lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )
    return found.withColumn("_more", apart).drop("_tokens")


def ownership(
    candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """By value hash: ``n_rows``, ``n_repositories``, ``n_owners`` and the ``verdict``, ``live`` or ``example``.

    ``candidates`` has hash, placeholder (whether the value looks like one), repository and owner. Counting goes by
    (hash, repository, owner) first, so that a value that a third of all rows have reaches the second count as few rows;
    null repositories or owners count as one.
    """
    looks = F.max("placeholder").alias("placeholder")
    pairs = candidates.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"), looks)
    counted = (
        pairs.groupBy("hash", "owner")
        .agg(F.sum("n").alias("n"), looks)
        .groupBy("hash")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_owners"), looks)
    )
    spread = pairs.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(
        F.count("*").alias("n_repositories")
    )
    example = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories) | F.col("placeholder")
    return counted.join(spread, "hash").select(
        "hash", "n_rows", "n_repositories", "n_owners", F.when(example, "example").otherwise("live").alias("verdict")
    )


def judged(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``secrets``: an array of start, kind_at, end, kind, value_at, verdict, in order of start and kind.

    ``docs`` needs ``text``, ``owner`` and ``repository`` columns; positions are code points, ends exclusive. A null or
    empty text has none; repeated rows each have theirs; texts are searched whole; an empty table stays empty. Own
    columns named ``secrets`` or beginning with an underscore are replaced. Rows without candidates are in no shuffle.
    """
    docs = docs.select([c for c in docs.columns if not c.startswith("_") and c != "secrets"])
    found = scanned(docs).withColumn("_row", F.monotonically_increasing_id())
    rows = saved(found if keep_text else found.drop("text"), "scanned")
    has = (F.size("_base") > 0) | (F.size("_more") > 0)
    candidates = rows.filter(has).select(
        "_row",
        F.col(owner).alias("owner"),
        F.col(repository).alias("repository"),
        F.explode(F.concat("_base", "_more")).alias("x"),
    )
    verdicts = ownership(candidates.select("owner", "repository", "x.hash", "x.placeholder"), max_owners, max_repositories)
    spans = (
        candidates.select("_row", "x.*")
        .join(verdicts.select("hash", "verdict"), "hash")
        .filter("kind != 'opaque' or verdict = 'live'")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind_at", "end", "kind", "value_at", "verdict"))).alias("secrets"))
    )
    none = F.array().cast(dict(spans.dtypes)["secrets"])
    hit = rows.filter(has).join(spans, "_row", "left").withColumn("secrets", F.coalesce("secrets", none))
    clean = rows.filter(~has).withColumn("secrets", none)
    return clean.unionByName(hit).drop("_base", "_more", "_row")


def redacted(docs: DataFrame, mask: str = MASK, **options) -> DataFrame:
    """``docs``, same columns, with the values of live-looking secrets replaced by ``mask``, and ``n_chars`` if there.

    Widely copied examples stay, and so does the name that a value is assigned to.
    """
    found = judged(docs, **options)

    def step(acc, x):
        ahead = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["value_at"] - acc["at"], F.lit(0)))
        fresh = F.when(x["value_at"] >= acc["at"], F.lit(mask)).otherwise(F.lit(""))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], ahead, fresh).alias("out")
        )

    live = F.filter("secrets", lambda x: x["verdict"] == "live")
    by_value = F.array_sort(F.transform(live, lambda x: F.struct(x["value_at"].alias("value_at"), x["end"].alias("end"))))
    masked = F.aggregate(
        by_value,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    changed = found.withColumn("text", F.when(F.size(live) > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn(
            "n_chars", F.when(F.size(live) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind)
        )
    return changed.select([c for c in docs.columns if c in changed.columns])

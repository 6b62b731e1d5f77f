"""The registered queries of this package: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeflow.llm import (
    fingerprints,
    jaccard,
    line_dedup,
    manifest,
    neighbours,
    packing,
    pieces,
    prefix_trie,
    secrets,
    sharding,
    token_counts,
    toxicity,
    warc,
)
from typeflow.llm.common import importable, saved, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    archive = warc.write_archive(warc.resolved(table(spark, sf_dir, "pages")))
    return warc.joined(saved(warc.read_archive(spark, archive), "records")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.segmented(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    base = F.filter("secrets", lambda x: x["kind"] != "opaque")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
        F.array_join("secrets.verdict", ",").alias("verdicts"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("kept", F.lit(""))
    return found.select(
        "doc_id",
        F.col("removed_lines").cast("bigint"),
        F.length(kept).cast("bigint").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("doc_id").cast("bigint"),
        sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    importable(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.verified(table(spark, sf_dir, "documents"), tampered)


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_neighbours": op2_neighbours,
        "op3_toxicity": op3_toxicity,
        "op4_warc": op4_warc,
        "op5_pieces": op5_pieces,
        "op6_secrets": op6_secrets,
        "op7_line_dedup": op7_line_dedup,
        "op8_jaccard": op8_jaccard,
        "op9_sharding": op9_sharding,
        "op10_packing": op10_packing,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_token_counts": op12_token_counts,
        "op13_manifest": op13_manifest,
    }


_WARC_SQL = """
    with p as (
      select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
      from pages),
    first as (select payload_digest, min(page_id) as page from p where payload_bytes >= 100 group by payload_digest)
    select page_id, payload_bytes, p.payload_digest, case when page <> page_id then 'revisit' else 'response' end as record_type,
      case when page <> page_id then page end as refers_to
    from p left join first on first.payload_digest = p.payload_digest"""

_JACCARD_SQL = """
    with recursive texts as (
      select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    words as (select doc_id, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as w from texts),
    shingled as (
      select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as g
      from words),
    members as (select doc_id, unnest(g) as shingle from shingled),
    sizes as (select doc_id, len(g)::bigint as n_shingles from shingled),
    shared as (
      select x.doc_id as a, y.doc_id as b, count(*) as common
      from members x join members y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
    linked as (
      select a, b from shared join sizes s on s.doc_id = a join sizes t on t.doc_id = b
      where 100 * common >= 85 * (s.n_shingles + t.n_shingles - common)),
    ways as (select a, b from linked union all select b, a from linked),
    reached as (
      select doc_id, doc_id as low from sizes
      union
      select b, low from reached join ways on a = doc_id where low < b)
    select doc_id, n_shingles, min(low) as component_id from reached join sizes using (doc_id) group by doc_id, n_shingles"""


def _crc32_sql(number: str) -> str:
    """CRC-32 of a number's decimal digits: each byte is one exclusive or and eight shifts."""
    steps = f"flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split({number}::varchar, '')])"
    shifted = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"""xor(list_reduce(list_concat([4294967295::bigint], {steps}),
      lambda a, b: case when b >= 0 then xor(a, b) else {shifted} end), 4294967295)"""


_TRIE_SQL = f"""
    with turned as (
      select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn,
        sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
      from conversations where conv_id is not null),
    own as (
      select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, digest) as turns, {_crc32_sql("conv_id")} % 9 as h
      from turned group by conv_id),
    built as (
      select c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) as path
      from own c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
    prefix as (select conv_id, unnest(range(0, len(path) + 1)) as depth, path from built),
    member as (select conv_id, depth, path[:depth] as node, depth = len(path) as ends from prefix),
    node as (
      select node, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
      from member group by node),
    child as (select node[:depth - 1] as node, count(*) as n_children from node where depth > 0 group by 1),
    known as (
      select n.*, coalesce(n_children, 0) as n_children,
        case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(n.node[depth].text)) end as own_saved
      from node n left join child c on c.node = n.node),
    above as (
      select top.node, (known.n_children = 0)::bigint as leaf, known.own_saved
      from (select node, n_children, own_saved, unnest(range(0, depth + 1)) as up from known) known
      join known top on top.node = known.node[:known.up]),
    summed as (select node, sum(leaf)::bigint as n_leaves, sum(own_saved)::bigint as saved_tokens from above group by node)
    select k.conv_id, k.depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
    from known k join summed s on s.node = k.node left join known p on k.depth > 0 and p.node = k.node[:k.depth - 1]"""


def _encoded_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::varchar)) || ':' || ({value})::varchar, '-')"


def _leaf_sql(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(_encoded_sql(value) for value in values) + ")"


def _climb_sql(name: str, bottom: str) -> str:
    """All levels of every tree of ``bottom`` (t, i, n, digest)."""
    return f"""{name} as (
      select t, 0 as level, i, n, digest from {bottom}
      union all
      select t, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by i))
      from {name} where n > 1 group by t, level, i // 2)"""


def _walk_sql(name: str, bottom: str, tree: str) -> str:
    """Each leaf of ``bottom`` (id, t, i, n, folded, proof) with its siblings from ``tree`` folded in, level by level."""
    return f"""{name} as (
      select id, t, 0 as level, i, n, folded, proof from {bottom}
      union all
      select w.id, w.t, w.level + 1, w.i // 2, (w.n + 1) // 2,
        sha256(case when w.i % 2 = 1 then s.digest || w.folded else w.folded || coalesce(s.digest, '') end),
        w.proof || coalesce(s.digest, '')
      from {name} w left join {tree} s on s.t = w.t and s.level = w.level and s.i = w.i + 1 - 2 * (w.i % 2)
      where w.n > 1)"""


_MANIFEST_SQL = f"""
    with recursive raw as (
      select *, {_leaf_sql("n_chars")} as leaf,
        case when {_crc32_sql("coalesce(doc_id, 0)")} % 7 = 0 and doc_id is not null and n_chars is not null
          then {_leaf_sql("n_chars + 1")} else {_leaf_sql("n_chars")} end as shown,
        coalesce('l' || lang, '0') as tree_key
      from documents),
    placed as (
      select *, row_number() over () as id, row_number() over (partition by tree_key order by doc_id nulls first, leaf) - 1 as i,
        count(*) over (partition by tree_key) as n
      from raw),
    bottom as (select tree_key as t, i, n, leaf as digest from placed),
    {_climb_sql("tree", "bottom")},
    subroot as (
      select t as tree_key, '' as t, row_number() over (order by t) - 1 as i, count(*) over () as n, digest from tree where n = 1),
    {_climb_sql("upper", "subroot")},
    leaves as (select id, tree_key as t, i, n, shown as folded, '' as proof from placed),
    {_walk_sql("walk", "leaves", "tree")},
    halfway as (
      select w.id, s.t, s.i, s.n, w.folded, w.proof from walk w join subroot s on s.tree_key = w.t where w.n = 1),
    {_walk_sql("rest", "halfway", "upper")}
    select p.doc_id, p.leaf, s.digest as subroot, u.digest as root, sha256(r.proof) as proof_sha256, r.folded as folded_root,
      r.folded = u.digest as verified
    from placed p join rest r on r.id = p.id and r.n = 1 join subroot s on s.tree_key = p.tree_key, (select digest from upper where n = 1) u"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {
        "op4_warc": _WARC_SQL,
        "op8_jaccard": _JACCARD_SQL,
        "op11_conversation_trie": _TRIE_SQL,
        "op13_manifest": _MANIFEST_SQL,
    }

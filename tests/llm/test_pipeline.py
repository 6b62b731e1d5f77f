"""The pipeline: stages in order, each taking effect on what the one before kept."""

import random

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tests.llm.test_line_dedup import prose

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, documents, tmp_path):
    rng = random.Random(1)
    base = prose(rng, 200)
    words = base.split(" ")
    words[20], words[90] = "changed", "other"
    passage = prose(rng, 70).strip()
    rows = [(i, prose(rng, 90), f"s{i % 4}") for i in range(40)]
    rows += [(50, "you idiot moron scum clown loser " + prose(rng, 20)), (51, base), (52, " ".join(words)), (53, base)]
    rows += [(60, prose(rng, 40) + " " + passage), (61, prose(rng, 40) + " " + passage)]
    rows += [(70, 'token = "9f86d081884c7d659a2feaa0c55ad015" here'), (71, ""), (72, None), (None, "nameless words here")]
    documents(rows, ["'x' as extra"]).drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "secrets", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "test")
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    everyone = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert everyone - set(kept["toxicity"]) == {50}
    assert set(kept["toxicity"]) - set(kept["line dedup"]) == {53}
    assert len(kept["line dedup"][61]) < len(kept["toxicity"][61]) and kept["line dedup"][60] == kept["toxicity"][60]
    assert set(range(40)) <= set(kept["near duplicates"]) and kept["secrets"][70] == 'token = "[SECRET]" here'
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in placed} == set(kept["secrets"])


@pytest.mark.parametrize("name", [n for n in registered.queries() if n.startswith("op") or n == "pipeline"])
def test_registered_queries_run_over_whole_tables(spark, name):
    rows = registered.queries()[name](spark, SF_DIR)
    assert len(set(rows.columns)) == len(rows.columns)
    if name.startswith("op11_"):  # a node for each prefix: the root has every conversation
        talks = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct().count()
        assert rows.filter("depth = 0").first().n_convs == talks
        return
    table, key = {"op2_": ("embeddings", "query_id"), "op4_": ("pages", "page_id")}.get(name[:4], ("documents", "doc_id"))
    found = {r[0] for r in rows.select(key).distinct().collect()}
    whole = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select({"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")).collect()}
    if name == "op2_neighbours":
        whole = {i for i in whole if i % 20 == 0}
    assert found == whole if name != "pipeline" else found <= whole


def test_stages_hand_texts_to_python_in_small_batches(spark, documents):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    @corpus_pipeline.stage
    def sizes(spark, docs, sf_dir):
        return docs.mapInArrow(lambda batches: (b.select(["doc_id"]) for b in batches for _ in [assert_small(b)]), "doc_id bigint")

    def assert_small(batch):
        assert batch.num_rows <= 1000

    try:
        spark.conf.set(key, "10000")
        assert sizes(spark, documents(["a"] * 3000).coalesce(1), "").count() == 3000
        spark.conf.set(key, "200")
        sizes(spark, documents(["a"]), "")
        assert spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, before)

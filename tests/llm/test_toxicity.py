"""Toxicity: the label model on known voters, held-out accuracy, and what scores may depend on."""

import random
import zlib

import numpy as np
import pytest

from typeflow.llm import toxicity

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "", "ll")]
FOREIGN = ["zrakko", "vuumpi", "skreblu", "quorzel"]


def corpus(count=900, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        words = [rng.choice(WORDS) for _ in range(rng.choice([8, 60, 300]))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(FOREIGN if i % 2 else ["idiot", "scum", "loser"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_quality(spark, documents):
    rows, labels = corpus()
    truth = {i: any(w in text.split() for w in FOREIGN + ["idiot", "scum", "loser"]) for i, text in rows}
    found = toxicity.scored(documents(rows), label_table(spark, labels)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out]
    assert sum(p and t for p, t in out) >= 0.9 * sum(t for _, t in out)
    assert sum(p and not t for p, t in out) <= 0.02 * len(out)


def test_labels_of_the_held_out_fold_change_nothing(spark, documents):
    rows, labels = corpus(400)
    docs = documents(rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (
        {r.doc_id: r.score for r in toxicity.scored(docs, label_table(spark, x)).collect()} for x in (labels, flipped)
    )
    assert one == two


def test_nulls_empty_texts_repeated_rows_and_no_labels(spark, documents):
    rows = [(None, None), (1, ""), (2, "you idiot scum loser"), (2, "you idiot scum loser"), (3, "fine " * 30_000)]
    docs = documents(rows, ["'c' as score", "1 as pattern"])
    found = toxicity.scored(docs, label_table(spark, [])).collect()
    assert len(found) == 5 and not any(r.held_out for r in found if r.doc_id is None)
    assert sorted((r.doc_id or 0, r.predicted) for r in found) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    assert len({r.score for r in found if r.doc_id == 2}) == 1
    assert toxicity.scored(docs.limit(0), label_table(spark, [(1, 1, 1), (None, 1, 1), (2, 1, None)])).count() == 0
    kept = toxicity.accepted(docs, label_table(spark, []))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_accepted_rows_are_those_not_predicted(spark, documents):
    rows, labels = corpus(300)
    docs, table = documents(rows), label_table(spark, labels)
    good = {r.doc_id for r in toxicity.scored(docs, table).collect() if not r.predicted}
    assert {r.doc_id for r in toxicity.accepted(docs, table).collect()} == good


def test_the_label_model_finds_accuracies_and_dependences():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.25
    rates = [(0.9, 0.02), (0.7, 0.1), (0.6, 0.05), (0.8, 0.2), (0.5, 0.1), (0.75, 0.05), (0.65, 0.15), (0.0, 0.0)]
    votes = np.stack([rng.random(len(y)) < np.where(y, p, q) for p, q in rates], axis=1)
    votes[:, 7] = votes[:, 1] ^ (rng.random(len(y)) < 0.03)  # nearly a copy of voter 1
    pattern = (votes << np.arange(8)).sum(axis=1)
    labels = np.where(rng.random(len(y)) < 0.05, y.astype(int), -1)
    keys, counts = np.unique(np.stack([pattern, labels], axis=1), axis=0, return_counts=True)
    model = toxicity.fit_label_model(keys[:, 0], keys[:, 1], counts)
    assert abs(model.prior - 0.25) < 0.03
    assert model.parent[7] == 1 or model.parent[1] == 7
    assert abs(model.tables[0, 1, 0] - 0.9) < 0.05
    right = (model.posterior(pattern, np.full(len(y), -1)) >= 0.5) == y
    assert right.mean() > 0.95


@pytest.mark.parametrize("most", [10, 1000])
def test_learning_labels_are_bounded_and_keep_to_their_folds(spark, most):
    labels = label_table(spark, [(i % 300, 1, i % 2) for i in range(600)] + [(None, 1, 1), (5, 1, None)])
    found = toxicity.learning_labels(labels, most).collect()
    assert len(found) <= most and len({r.doc_id for r in found}) == len(found)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in found)

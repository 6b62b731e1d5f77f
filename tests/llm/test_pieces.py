"""Sampled segmentations: exact probabilities, reproducible draws, lossless decoding."""

import math
import random
from collections import Counter

import pytest

from typeflow.llm import pieces

TEXTS = ["", " ", "  a  b ", "plain words here", "▁ ▁x", "\n\t\x00é日本🙂", "a" * 3000, "Ünïcode ß…", "x　y", "1,000 2.5e3!!"]


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def segment(model):
    return pieces.Segmenter(model)


def ways(segment, word):
    if not word:
        yield (), 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in segment.vocabulary.id_of:
            for rest, weight in ways(segment, word[k:]):
                yield (segment.vocabulary.id_of[word[:k]], *rest), weight + segment.vocabulary.log_weight[word[:k]]


@pytest.mark.parametrize("word", [" thation", "the", " été"])
def test_draws_follow_the_probabilities_of_all_ways(segment, word):
    every = dict(ways(segment, word))
    whole = sum(math.exp(w) for w in every.values())
    n = 20_000
    found = Counter(tuple(x.tolist()) for x in segment(list(range(n)), [word.strip() if word[0] != " " else "x" + word] * n))
    head = () if word[0] != " " else (segment.vocabulary.id_of["x"],)
    assert set(found) <= {(*head, *ids) for ids in every}
    for ids, weight in every.items():
        p = math.exp(weight) / whole
        assert abs(found[(*head, *ids)] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_draws_depend_on_the_key_alone(segment):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["station", "nation", "relation", "x"]) for _ in range(30)) for _ in range(40)]
    together = segment(list(range(40)), texts)
    apart = [segment([i], [t])[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(together, apart))
    assert any(a.tolist() != b.tolist() for a, b in zip(together, segment(list(range(100, 140)), texts)))


def test_decoding_is_lossless(spark, documents, model):
    docs = documents([*TEXTS, None, "copy", "long text " * 30_000], ["'x' as ids"])
    rows = pieces.segmented(docs, model)
    found = {r.doc_id: r for r in rows.collect()}
    assert all(r.lossless for r in found.values()) and len(found) == docs.count()
    assert found[len(TEXTS)].n_pieces == 0
    back = {r.doc_id: r.text for r in pieces.decoded(rows, model).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS and back[len(TEXTS)] == ""


def test_null_keys_repeated_rows_and_empty_tables(documents, model):
    rows = pieces.segmented(documents([(None, "station"), (7, "station"), (7, "station")]), model).collect()
    assert len(rows) == 3 and len({r.ids_crc32 for r in rows if r.doc_id == 7}) == 1
    assert pieces.segmented(documents([]), model).count() == 0

"""Fingerprints: collision rates against exact weighted Jaccard, and successors against sorting."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from typeflow.llm import fingerprints


def weights(text):
    return {w: 1 + math.log(n) for w, n in Counter(text.lower().split()).items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    least = sum(min(a[w], b.get(w, 0)) for w in a)
    most = sum(a.values()) + sum(b.values()) - least
    return least / most if most else 1.0


def prose(rng, n):
    return " ".join(rng.choice([f"w{rng.randrange(40)}", f"v{rng.randrange(3000)}"]) for _ in range(n))


def test_collision_rates_equal_the_generalised_jaccard_similarity():
    rng, sample = random.Random(1), fingerprints.Sampler(512)
    errors = []
    for _ in range(80):
        a = prose(rng, rng.choice([20, 200, 900]))
        b = " ".join(w for w in a.split() if rng.random() > 0.3) + " " + prose(rng, rng.choice([1, 60]))
        errors.append(fingerprints.likeness(sample(a), sample(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.sqrt(np.mean(np.square(errors))) < 0.03


def test_a_sample_does_not_depend_on_what_was_seen_before(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 300) for _ in range(20)] + ["", "   ", "one"]
    whole = fingerprints.Sampler()
    first = [whole(t) for t in texts]
    monkeypatch.setattr(fingerprints, "CACHE", 64)
    small = fingerprints.Sampler()
    assert all((small(t) == f).all() for t, f in zip(reversed(texts), reversed(first)))
    assert not first[-3].any() and not first[-2].any() and first[-1].all()


@pytest.mark.parametrize("rows", [1, 2, 300])
def test_successors_and_edited_texts(documents, rows):
    rng = random.Random(rows)
    ids = rng.sample(range(10**6), rows)
    texts = {i: rng.choice(["", "é" * 7, prose(rng, rng.randint(1, 50))]) for i in ids}
    docs = documents([(i, t or None) for i, t in texts.items()], ["'x' as bucket", "1 as key"])
    found = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    assert sorted(found) == sorted(ids)
    sample, order = fingerprints.Sampler(), sorted(ids)
    for i, following in zip(order, order[1:] + order[:1]):
        text, other, r = texts[i], texts[following], found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed = sample(text), sample(edited)
        assert r.fingerprint == own.astype(">u2").tobytes().hex()
        assert r.near_edited == fingerprints.likeness(own, changed)
        assert r.near_next == fingerprints.likeness(own, sample(other))


def test_null_ids_repeated_rows_and_empty_tables(documents):
    rows = [(None, "a b"), (None, "c"), (4, "x y"), (4, "x y"), (2, "long " * 50_000)]
    found = fingerprints.fingerprinted(documents(rows)).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 0, 2, 4, 4]
    assert len({r.fingerprint for r in found if r.doc_id == 4}) == 1
    assert fingerprints.fingerprinted(documents([])).count() == 0

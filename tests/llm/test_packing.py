"""Packing against the tokenizers library and a plain best-fit decreasing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from typeflow.llm import packing

ODD = ["", " ", "a", " a b", "a  b", "a \n b", "it's we'll 'sx", "x<|endoftext|>y", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "\n\na b", "日本 語。", "é ", "a\tb\x85c", "🙂 🙃x"]


@pytest.fixture(scope="module")
def library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(vocabulary)
    return lambda text: found.encode(text, add_special_tokens=False).ids + [packing.END_ID]


def texts(seed=1, count=300):
    rng = random.Random(seed)
    words = ["the", "Zeit", "été", "3.14", "don't", "\n", "", "x", "naïve", "<|endoftext|>", "…"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60]))) for _ in range(count)]


def test_ids_are_those_of_the_tokenizers_library(vocabulary, library):
    encode = packing.encoder(vocabulary).ids
    for text in texts():
        assert encode(text).tolist() == library(text)
    assert encode(None).tolist() == [packing.END_ID]


def plain_best_fit(histogram, window):
    remaining = []
    for size in sorted(Counter(histogram).elements(), reverse=True):
        fits = [i for i, r in enumerate(remaining) if r >= size]
        if fits:
            remaining[min(fits, key=lambda i: remaining[i])] -= size
        else:
            remaining.append(window - size)
    return sorted(remaining)


@pytest.mark.parametrize("seed", range(12))
def test_steps_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 64])
    histogram = Counter(rng.randint(1, window) for _ in range(rng.choice([0, 1, 30, 200])))
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, items, first, fit, offset in packing.best_fit_decreasing(histogram, window):
        for i in range(items):
            filled[first + i // fit].append((offset + i % fit * length, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert sorted(filled) == list(range(len(filled)))
    left = []
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        left.append(window - end)
    assert sorted(left) == plain_best_fit(histogram, window)


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_cover_documents_and_sequences_have_no_gaps(documents, vocabulary, library, window, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 7)
    rows = texts() + ["a b c"] * 50 + [None, "word " * 5000]
    docs = documents(rows, ["'x' as start", "1 as length", "2 as sequence_id"])
    placed = packing.pack(docs, vocabulary, window, ids=True)
    found = placed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(rows):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist()
        assert ids == library(text or "") and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for r in packing.sequences(placed, window).collect():
        used = sum(length for _, length in by_sequence[r.sequence_id])
        assert len(r.ids) == 4 * (used + r.padding) and r.padding == (0 if used & (used - 1) == 0 else window - used)


def test_empty_tables_repeated_rows_and_null_ids(documents, vocabulary):
    assert packing.pack(documents([]), vocabulary).count() == 0
    rows = packing.pack(documents([(1, "a b"), (1, "a b"), (None, "c"), (None, None)]), vocabulary).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4

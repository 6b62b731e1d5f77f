import json
import random

import pytest

from typeflow.llm import token_counts as counts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def word_vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(word_vocabulary):
    tokenizer = tokenizers.Tokenizer.from_file(word_vocabulary)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


HARD = [
    "", " ", "\n\t\r\f\v", "plain words, and more-words", "It's we'll I'M they'D 's 'tis x's'll",
    "a\x1cb\x1fc\x85d e f　g​h﻿i", "Σ ΟΔΟΣ ΟΔΟΣ. İstanbul ẞ ﬁ Ǆ", "é ́e e ́", "한국어 한 日本語テキスト",
    "12345 ½ ² ١٢٣ 1a2b", "👩‍👩‍👧 🇩🇪 ☃️", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>c", "<|ENDOFTEXT|> <|endoftext |> <|end", "x<|endoftext|>́y",
    "a\x00b \x7f", "x" * 50_000, "é" * 30_000, "!?" * 10_000, "word " * 40_000, "the" + "‍" * 70 + "end",
]


def test_counts_equal_the_librarys(spark, documents, word_vocabulary, library):
    rng = random.Random(5)
    alphabet = "abcdeXYZ'’0189 .,-_\n\téÉßΣσ́ 日\U0001f600<|>"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    df = documents([*texts, None, texts[3]], extra=["1 as n_tokens", "'x' as n_bytes", "true as over_limit"])
    got = {r.doc_id: r for r in counts.token_counts(df, word_vocabulary).collect()}
    assert len(got) == len(texts) + 2
    for k, text in enumerate([*texts, "", texts[3]]):
        expected = (len(text.encode()), library(text), library(text) > 2048)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == expected, repr(text[:80])


def test_forgetting_words_changes_nothing(word_vocabulary, library, monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    count = counts.counter(word_vocabulary, counts.proven_whole(word_vocabulary))
    text = "the cat sat on the unlikeliest of the mats, onthemat onthemat the cat " * 3
    assert count(text.encode()) == library(text)


def test_whole_strings_are_one_token_and_most_are(word_vocabulary, library):
    whole = counts.proven_whole(word_vocabulary)
    with open(word_vocabulary, encoding="utf-8") as file:
        ending = [s for s in json.load(file)["model"]["vocab"] if s.endswith("</w>")]
    assert 0.9 * len(ending) < len(whole) <= len(ending)
    plain = [s for s in whole if s.isascii() and s.isalpha() and s.islower()]
    assert len(plain) > 10_000 and all(library(s) == 1 for s in plain[:3000])


def test_the_rest_is_merged(word_vocabulary, library):
    """Without any proven string the counts are the same: the shortcut only saves work."""
    text = "Several words, some of which are unquestionably longerthanusual; and numbers 42."
    assert counts.counter(word_vocabulary, frozenset())(text.encode()) == library(text)


def test_other_vocabularies_are_refused():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        counts.proven_whole(path)


def test_empty_table(spark, documents, word_vocabulary):
    assert counts.token_counts(documents([]), word_vocabulary).collect() == []

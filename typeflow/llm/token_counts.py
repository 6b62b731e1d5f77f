"""Token counts by the whole-token shortcut.

The vocabulary's tokenizer drops white space and merges pieces of text (pre-tokens) on their own, so a text's count is
the sum over its pre-tokens. Offline, on the driver, every vocabulary string that ends a word is put through the merges
alone; those that stay one token are proven whole. Tasks count a pre-token among them directly and merge only the rest.
Words between white space are looked up first, so normalizing and splitting are done once for each word and batch of
memory, not once for each occurrence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a sequence may hold.
LIMIT = 2048
#: Words remembered by a task at once, and the longest remembered.
REMEMBERED, LONGEST = 1 << 18, 64


def _settings(vocabulary: str) -> dict:
    with open(vocabulary, encoding="utf-8") as file:
        return json.load(file)


def special_strings(settings: dict) -> list[str]:
    """The strings that are one token each wherever a text holds them, longest first."""
    added = settings.get("added_tokens") or []
    if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    return sorted((token["content"] for token in added), key=len, reverse=True)


def proven_whole(vocabulary: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token, as the pre-tokenizer writes them, without the word's end mark.

    Raises ValueError for a vocabulary whose words aren't independent of each other.
    """
    from tokenizers import Tokenizer

    settings = _settings(vocabulary)
    model = settings["model"]
    end = model.get("end_of_word_suffix") or ""
    tokenizer = Tokenizer.from_file(vocabulary)
    special_strings(settings)
    if settings.get("truncation") or settings.get("padding") or model.get("dropout"):
        raise ValueError("a tokenizer that truncates, pads or draws is not supported")
    apart = [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str("a \t\r\n\f\vb")]
    if apart != ["a", "b"]:
        raise ValueError("the tokenizer keeps white space, so words can't be counted apart")
    whole = set()
    for string, number in model["vocab"].items():
        if end and not string.endswith(end):
            continue
        alone = string[: len(string) - len(end)]
        merged = tokenizer.model.tokenize(alone) if alone else []
        if len(merged) == 1 and merged[0].id == number:
            whole.add(alone)
    return frozenset(whole)


class _Words(dict):
    """Tokens of each word (UTF-8 without white space), found when first asked for."""

    def __init__(self, tokenizer, whole: frozenset[str]):
        super().__init__()
        self._normalize = tokenizer.normalizer.normalize_str
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = tokenizer.model.tokenize
        self._whole = whole

    def __missing__(self, word: bytes) -> int:
        tokens = 0
        for piece, _ in self._split(self._normalize(word.decode("utf-8", "replace"))):
            tokens += 1 if piece in self._whole else len(self._merge(piece))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = tokens
        return tokens


def counter(vocabulary: str, whole: frozenset[str]) -> Callable[[bytes], int]:
    """A function from a text in UTF-8 to its number of tokens."""
    from tokenizers import Tokenizer

    specials = [string.encode() for string in special_strings(_settings(vocabulary))]
    pattern = re.compile(b"|".join(map(re.escape, specials))) if specials else None
    words = _Words(Tokenizer.from_file(vocabulary), whole)

    def count(text: bytes) -> int:
        found = 0
        if pattern is not None and pattern.search(text):
            # What stands on both sides of a special string is normalized and split apart, as by white space.
            text, found = pattern.subn(b" ", text)
        # Splitting bytes cuts at ASCII white space, which every tokenizer of this kind drops; other white space stays.
        return found + sum(map(words.__getitem__, text.split()))

    return count


#: Kept by a Python worker from task to task.
_counters: dict[str, Callable[[bytes], int]] = {}


def _kept_counter(vocabulary: str, whole: Callable[[], frozenset[str]]) -> Callable[[bytes], int]:
    if vocabulary not in _counters:
        _counters[vocabulary] = counter(vocabulary, whole())
    return _counters[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``) of each row's whole text.

    Counts are those of the vocabulary's library, without begin or end tokens, truncation or padding; special strings
    inside texts are the special tokens, its default. A NULL text is empty and has no tokens. Every row gives one,
    repeated rows too; other columns are left out.
    """
    # Bounded by the vocabulary, whatever the corpus.
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole(vocabulary))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _kept_counter(vocabulary, lambda: whole.value)
        for batch in batches:
            texts = batch.column("text")
            sizes = [count(text.as_py()) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )

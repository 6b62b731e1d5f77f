"""Sampled segmentations of texts into the pieces of a SentencePiece vocabulary.

The lattice of a word has a node at every character and an edge for every piece that covers the characters between two
nodes. The forward pass adds up the weights of all ways to each node; backward sampling then draws, from the word's
end, each piece with its exact probability among all ways. Draws follow from the row's key alone, so a segmentation is
reproducible whatever the partitioning. Spaces begin words and no piece goes over a word's begin, so words are
independent, and the lattice of a word is built once for all its occurrences.

The vocabulary file holds merge ranks; pieces are weighted by Zipf's law of their rank. Characters that no piece has
become their UTF-8 bytes' pieces, so decoding gives back every text.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import importable

#: How sharp the choice is: 0 draws all ways alike, large values nearly always the likeliest.
ALPHA = 1.0
SEED = 7
SPACE = "▁"
#: Characters that a worker segments at a time.
CHARACTERS = 4_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Vocabulary:
    """The pieces of a model file: what each stands for, in bytes, and its weight."""

    def __init__(self, model: str):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=model)
        size = known.get_piece_size()
        self.surface: list[bytes] = [b""] * size
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        for i in range(size):
            piece = known.id_to_piece(i)
            if known.is_byte(i):
                value = int(piece[3:5], 16)
                self.surface[i], self.byte_id[value] = bytes([value]), i
            elif not (known.is_control(i) or known.is_unknown(i) or known.is_unused(i)):
                # In lattices a space is a space; a text's own U+2581 has no piece and becomes bytes.
                shown = piece.replace(SPACE, " ")
                self.surface[i], self.id_of[shown] = shown.encode(), i
        ranks = {i: rank for rank, i in enumerate(sorted(self.id_of.values(), key=lambda i: -known.get_score(i)), 1)}
        self.log_weight = {piece: -math.log(ranks[i]) for piece, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.rarest = -math.log(len(ranks) + 1)


class Segmenter:
    """Segments texts by the batch; the lattices of all distinct words of a batch are built together."""

    def __init__(self, model: str, alpha: float = ALPHA, seed: int = SEED):
        self.vocabulary, self.alpha, self.seed = Vocabulary(model), alpha, seed
        self._units = [(i,) for i in range(len(self.vocabulary.surface))]  # what an edge stands for: ids
        self._bytes: dict[str, int] = {}
        # Of each length, the pieces' hashes in order, with their ids and weights.
        self._known = []
        for length in range(1, self.vocabulary.longest + 1):
            some = [p for p in self.vocabulary.id_of if len(p) == length]
            h = np.zeros(len(some), np.uint64)
            for i in range(length):
                h = h * _MIX[0] + np.array([ord(p[i]) + 1 for p in some], np.uint64)
            order = np.argsort(h)
            ids = np.array([self.vocabulary.id_of[p] for p in some], np.int64)[order]
            self._known.append((h[order], ids, np.array([self.vocabulary.log_weight[p] for p in some])[order]))

    def _fallback(self, character: str) -> int:
        """The unit of a character's bytes."""
        if character not in self._bytes:
            self._bytes[character] = len(self._units)
            self._units.append(tuple(self.vocabulary.byte_id[b] for b in character.encode()))
        return self._bytes[character]

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges of the words whose characters follow each other in ``codes``: begin, end, unit and weight.
        ``ends`` has, for each character, where its word ends. Edge (i, j) covers characters i to j - 1."""
        begin, end, unit, weight = [], [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for length, (known, ids, weights) in enumerate(self._known, 1):
            inside = at + length <= ends[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * _MIX[0] + codes[at + length - 1] + np.uint64(1)
            place = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else None
            found = known[place] == h if len(known) else np.zeros(len(at), bool)
            if found.any():
                begin.append(at[found])
                end.append(at[found] + length)
                unit.append(ids[place[found]])
                weight.append(weights[place[found]])
            if length == 1 and not found.all():
                bare = at[~found]
                letters, which = np.unique(codes[bare], return_inverse=True)
                units = np.array([self._fallback(chr(c)) for c in letters.tolist()], np.int64)
                sizes = np.array([len(self._units[u]) for u in units])
                begin.append(bare)
                end.append(bare + 1)
                unit.append(units[which])
                weight.append((self.vocabulary.rarest * sizes)[which])
        return tuple(np.concatenate(x) for x in (begin, end, unit, weight))

    def lattices(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Forward passes. Nodes are characters, each standing for the place behind it; for each node its edges stand
        together: where the first one is (``first``), the sum of probabilities up to each, the node before (-1 at a
        word's begin) and the unit. Also each word's last node."""
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        begin, end, unit, weight = self._edges(codes, np.repeat(stops, sizes))
        starts = stops - sizes
        place = end - 1 - np.repeat(starts, sizes)[end - 1]  # of the edge's end in its word
        order = np.lexsort((end, place))
        begin, end, unit, weight, place = (x[order] for x in (begin, end, unit, weight, place))
        word_begin = begin == np.repeat(starts, sizes)[begin]
        total, share = np.zeros(len(codes)), np.empty(len(end))
        cuts = np.searchsorted(place, np.arange(place[-1] + 2))
        for low, high in zip(cuts[:-1], cuts[1:]):  # all words' nodes at one place
            value = np.where(word_begin[low:high], 0, total[begin[low:high] - 1]) + self.alpha * weight[low:high]
            node = end[low:high] - 1
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            each = np.diff(np.concatenate([heads, [len(node)]]))
            most = np.repeat(np.maximum.reduceat(value, heads), each)
            share[low:high] = np.exp(value - most)
            whole = np.add.reduceat(share[low:high], heads)
            total[node[heads]] = most[heads] + np.log(whole)
            share[low:high] /= np.repeat(whole, each)
        node = end - 1
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        first = np.empty(len(codes), np.int64)
        first[node[heads]] = heads
        upto = np.cumsum(share)
        each = np.diff(np.concatenate([heads, [len(node)]]))
        upto -= np.repeat(upto[heads] - share[heads], each)
        upto[np.concatenate([heads[1:], [len(node)]]) - 1] = 2.0
        return first, upto, np.where(word_begin, -1, begin - 1), unit, stops - 1

    def __call__(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, drawn by its key."""
        number_of: dict[str, int] = {}
        word, counts = [], []
        for text in texts:
            words = split_words(text) if text else []
            word += [number_of.setdefault(w, len(number_of)) for w in words]
            counts.append(len(words))
        if not word:
            return [np.zeros(0, np.int64) for _ in texts]
        first, upto, before, unit_of, last = self.lattices(list(number_of))
        counts = np.array(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = np.array(keys, np.int64).view(np.uint64)[owner] + np.uint64(self.seed * int(_STEP) % (1 << 64))
        seed = _mixed(_mixed(key) + number.astype(np.uint64) * _MIX[0])
        node, active, step, drawn = last[np.array(word)], np.arange(len(word)), 0, []
        while len(active):
            u = _mixed(seed[active] + np.uint64((step + 1) * int(_STEP) % (1 << 64)))
            u = (u >> np.uint64(11)).astype(float) / float(1 << 53)
            edge = first[node]
            todo = np.flatnonzero(upto[edge] <= u)
            while len(todo):
                edge[todo] += 1
                todo = todo[upto[edge[todo]] <= u[todo]]
            drawn.append((active, unit_of[edge]))
            node = before[edge]
            more = node >= 0
            active, node, step = active[more], node[more], step + 1
        # Pieces were drawn from the last to the first of each word.
        count = np.zeros(len(word), np.int64)
        for which, _ in drawn:
            count[which] += 1
        stop = np.cumsum(count)
        units = np.empty(stop[-1], np.int64)
        for back, (which, unit) in enumerate(drawn):
            units[stop[which] - 1 - back] = unit
        sizes = np.bincount(owner, count, len(texts)).astype(np.int64)
        plain = len(self.vocabulary.surface)
        return [
            x if not (x >= plain).any() else np.array([i for u in x.tolist() for i in self._units[u]], np.int64)
            for x in np.split(units, np.cumsum(sizes)[:-1])
        ]

    def decoded_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.surface.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded_bytes(ids).decode()


def split_words(text: str) -> list[str]:
    """The words of a text, spaces in front; more than one space in a row stands with the word behind."""
    parts = text.split(" ")
    if "" not in parts:
        return [parts[0]] + [" " + p for p in parts[1:]]
    words, spaces = [], ""
    for i, part in enumerate(parts):
        spaces += " " if i else ""
        if part:
            words.append(spaces + part)
            spaces = ""
    return words + [spaces] if spaces else words


@functools.lru_cache(2)
def segmenter(model: str, alpha: float = ALPHA, seed: int = SEED) -> Segmenter:
    return Segmenter(model, alpha, seed)


def segmented(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED, ids: bool = True) -> DataFrame:
    """A sampled segmentation of every row: ``doc_id``, ``n_pieces``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), ``lossless`` (whether decoding gave the text back) and, if asked for, ``ids``.

    The row's key is its doc_id; a null doc_id has key 0, and rows with one doc_id and text have one segmentation. Null and
    empty texts have no pieces. Texts are segmented whole; further columns are left out.
    """
    importable(docs.sparkSession)
    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * ids

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(model, alpha, seed)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            begin = 0
            while begin < len(docs):
                some, size, end = [], 0, begin
                while end < len(docs) and size < CHARACTERS:
                    some.append(texts[end].as_py() or "")
                    size += len(some[-1])
                    end += 1
                found = segment([d or 0 for d in docs[begin:end]], some)
                columns = [
                    pa.array(docs[begin:end], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([segment.decoded_bytes(x) == text.encode() for x, text in zip(found, some)]),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                begin = end

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(look, schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (doc_id, ids) with the ``text`` that the ids stand for; null ids give a null text."""
    importable(rows.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = segmenter(model).decode
        for batch in batches:
            texts = [None if x is None else decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(look, "doc_id bigint, text string")

"""Toxicity scores by weak supervision.

Many voters look at each text: a fixed list of insults, words mined from labelled texts in several groups, and patterns
(how often, how dense, how many different). A generative label model estimates, by expectation maximisation over the
counts of all vote patterns in the corpus, how accurate each voter is and which voters depend on each other (a tree of
the strongest dependences, given the label). Labels take part as one more voter that mostly abstains. The model's
posterior labels then train a linear classifier over the hit words, and its probability is the score.

Labels are learned from rows of the learning folds only: crc32 of the doc_id's text modulo 4 is not 2.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeflow.llm.common import importable, saved

#: Labelled rows that are learned from, at most; above it they are thinned by a hash of the doc_id.
MAX_LABELLED = 50_000
#: A mined word is in toxic texts of at least so many families, and these make up this share of all labelled texts
#: that have it, so many more texts that aren't toxic being assumed.
LEAST_FAMILIES, LEAST_SHARE, DOUBT = 4, 0.5, 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

# Common English insults, as a voter that needs no labels.
INSULTS = (
    "airhead ass asshole bastard bimbo bitch blockhead bonehead brainless clown coward creep cretin crook dimwit "
    "disgusting dolt dork douche dumb dumbass dunce fool freak garbage idiot idiotic imbecile jackass jerk lame loser "
    "lowlife lunatic maggot moron moronic numbskull nutcase parasite pathetic pig psycho retard retarded scum scumbag "
    "shit simpleton slut sucker stupid swine trash twit vermin vile weirdo whore wimp worthless wretch"
).split()

WORD = re.compile(r"[^\W\d_]+")
GROUPS = 4
#: Voters, one bit each: a fixed insult, two and four hits, hits in a tenth of the usual distance, and mined groups.
VOTERS = 4 + GROUPS


def held_out(doc_id: Column) -> Column:
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def learning_labels(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labels (doc_id, toxic) of the learning folds, without nulls; a doc_id with several labels is
    toxic if one of them says so. The same rows whatever the partitioning."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def mined_words(docs: DataFrame, known: DataFrame) -> list[str]:
    """All words that labelled texts have mostly where they are toxic, the most telling first: no more than the bounded
    sample of labelled texts has.

    Copies of one toxic text would make any of its words telling. So toxic texts are counted by family: texts with
    the same smallest word hash, which near copies mostly share.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = Counter()
        for batch in batches:
            toxic_words, families = [], []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(WORD.findall((text.as_py() or "").lower()))
                if toxic and words:
                    toxic_words += words
                    families += [min(zlib.crc32(w.encode()) for w in words)] * len(words)
                elif not toxic:
                    others.update(words)
            yield rows(toxic_words, families, [0] * len(toxic_words))
        yield rows(list(others), [None] * len(others), list(others.values()))

    def rows(words: list, families: list, n: list) -> pa.RecordBatch:
        arrays = [pa.array(words, pa.string()), pa.array(families, pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "family", "n_other"])

    labelled = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")  # at most MAX_LABELLED labels
    by_word = labelled.mapInArrow(counts, "word string, family bigint, n_other bigint")
    by_word = by_word.groupBy("word").agg(F.countDistinct("family").alias("families"), F.sum("n_other").alias("n_other"))
    share = (F.col("families") + 0.5) / (F.col("families") + F.col("n_other") + DOUBT + 0.5)
    best = by_word.filter(f"families >= {LEAST_FAMILIES}").withColumn("share", share).filter(f"share >= {LEAST_SHARE}")
    return [r[0] for r in best.orderBy(F.desc("share"), "word").select("word").collect()]


def hits(docs: DataFrame, words: list[str]) -> DataFrame:
    """What the voters see of every whole text: the listed words in it with their counts, and the vote pattern."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # words of the labelled sample, and the fixed list
    fixed = set(INSULTS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(shared.value)}
        insults = {i for w, i in at.items() if w in fixed}
        group = [4 + zlib.crc32(w.encode()) % GROUPS for w in shared.value]
        for batch in batches:
            sizes, patterns, ids, counts = [], [], [], []
            for text in batch.column(1):
                found = WORD.findall((text.as_py() or "").lower())
                seen = Counter(at[w] for w in found if w in at)
                total = sum(seen.values())
                pattern = (not insults.isdisjoint(seen)) | (total >= 2) << 1 | (len(seen) >= 4) << 2
                pattern |= (total * 100 >= max(len(found), 1)) << 3
                for i in seen:
                    pattern |= 1 << group[i]
                sizes.append(len(found))
                patterns.append(int(pattern))
                ids.append(list(seen))
                counts.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(patterns, pa.int32()),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "pattern", "ids", "counts"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        look, "doc_id bigint, n_words bigint, pattern int, ids array<int>, counts array<int>"
    )


@dataclass
class LabelModel:
    """P(label) and, of each voter, P(vote | label, vote of the voter it depends on)."""

    prior: float
    parent: list[int]
    tables: np.ndarray  # voter, label, parent's vote: P(vote = 1)
    label_accuracy: float

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of being toxic, for rows of 0/1 votes."""
        out = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            one, zero = self.tables[j, 1, above], self.tables[j, 0, above]
            out += np.where(votes[:, j] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return out

    def posterior(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic | votes and, where it isn't -1, the label)."""
        odds = self.log_odds(bits(patterns))
        known = np.log(self.label_accuracy / (1 - self.label_accuracy))
        odds = odds + np.where(labels < 0, 0, np.where(labels == 1, known, -known))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def bits(patterns: np.ndarray) -> np.ndarray:
    return (np.asarray(patterns)[:, None] >> np.arange(VOTERS)) & 1


def fit_label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over counts of (vote pattern, label or -1): at most 3 * 2 ** VOTERS of them."""
    votes, n = bits(patterns), counts.astype(float)
    known = labels >= 0
    rate = (n[labels == 1].sum() + 1) / (n[known].sum() + 10)
    model = LabelModel(min(max(rate, 0.001), 0.5), [-1] * VOTERS, np.empty((VOTERS, 2, 2)), 0.95)
    # To begin with: the label where there is one; else toxic where half of the voters that ever vote say so.
    share = votes.mean(axis=1)
    q = np.where(known, np.where(labels == 1, 0.95, 0.05), np.where(share >= 0.5, 0.9, 0.1 * share))
    for step in range(rounds):
        weight = np.stack([n * (1 - q), n * q])
        if step in (1, 5, 15):
            model.parent = dependence_tree(votes, weight)
        for j, p in enumerate(model.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                for v in (0, 1):
                    w = weight[y] * (above == v)
                    model.tables[j, y, v] = (w @ votes[:, j] + 0.5) / (w.sum() + 1)
        model.prior = float((weight[1].sum() + 1) / (n.sum() + 10))
        if known.any():
            right = (weight[1] * (labels == 1)).sum() + (weight[0] * (labels == 0)).sum()
            model.label_accuracy = float(np.clip((right + 19) / (n[known].sum() + 20), 0.9, 0.995))
        q = model.posterior(patterns, labels)
    return model


def dependence_tree(votes: np.ndarray, weight: np.ndarray) -> list[int]:
    """For each voter the voter it depends on most, given the label, as a tree with voter 0 at its root (-1)."""
    total = weight.sum()
    gain = np.zeros((VOTERS, VOTERS))
    for i in range(VOTERS):
        for j in range(i):
            for y in (0, 1):
                size = weight[y].sum()
                if size <= 0:
                    continue
                joint = np.array([[(weight[y] * (votes[:, i] == a) * (votes[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)])
                joint = (joint + 0.25) / (size + 1)
                apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
                gain[i, j] += size / total * (joint * np.log(joint / apart)).sum()
            gain[j, i] = gain[i, j]
    parent, inside = [-1] * VOTERS, {0}
    while len(inside) < VOTERS:
        i, j = max(((i, j) for i in inside for j in range(VOTERS) if j not in inside), key=lambda e: (gain[e], e))
        parent[j] = i
        inside.add(j)
    return parent


@dataclass
class Classifier:
    weights: np.ndarray  # a weight for each word, then those of the dense features and the constant

    @staticmethod
    def features(n_words: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, words: int):
        """Sparse rows: capped counts of the words, hits in all, their density, and a constant."""
        row = np.repeat(np.arange(len(n_words)), np.diff(offsets))
        total = np.bincount(row, counts, len(n_words))
        dense = np.stack([np.log1p(total), np.minimum(total * 50 / np.maximum(n_words, 1), 3), total > 0, np.ones(len(n_words))])
        rows = np.concatenate([row, np.tile(np.arange(len(n_words)), 4)])
        columns = np.concatenate([ids, np.repeat(words + np.arange(4), len(n_words))])
        return rows, columns, np.concatenate([np.minimum(counts, 3) / 3, dense.ravel()])

    def scores(self, n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        margin = np.bincount(rows, self.weights[columns] * values, n)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))

    @classmethod
    def fit(cls, n: int, rows, columns, values, target: np.ndarray, prior: np.ndarray, rounds: int = 400, ridge: float = 1e-3):
        """Logistic regression on soft labels by gradient steps with momentum, each weight at its own pace. The ridge
        pulls to ``prior``, which labels overrule where they say anything."""
        model = cls(prior.copy())
        size = len(prior)
        mean, square = np.zeros(size), np.zeros(size)
        for step in range(1, rounds + 1):
            error = model.scores(n, rows, columns, values) - target
            gradient = np.bincount(columns, error[rows] * values, size) / max(n, 1) + ridge * (model.weights - prior) / max(n, 1) * 100
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            model.weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return model


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def learned(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[list[str], Classifier, DataFrame]:
    """The words looked at, the classifier, and the stored hits of all rows."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = saved(learning_labels(labels, max_labelled), "labels")
    words = [*INSULTS, *(w for w in mined_words(docs, known) if w not in set(INSULTS))]
    seen = saved(hits(docs, words), "hits")

    small = F.broadcast(known)  # at most max_labelled rows
    voted = seen.join(small, "doc_id", "left").groupBy("pattern", F.coalesce("toxic", F.lit(-1)).alias("label")).count()
    table = np.array([tuple(r) for r in voted.collect()], dtype=np.int64).reshape(-1, 3)
    model = fit_label_model(table[:, 0], table[:, 1], table[:, 2])

    rows = seen.join(small, "doc_id").limit(2 * max_labelled).toArrow()
    prior = np.r_[np.full(len(INSULTS), 6.0), np.zeros(len(words) - len(INSULTS) + 3), -3.0]
    if not len(rows):
        return words, Classifier(prior), seen
    ids, offsets = _flat(rows["ids"])
    counts, _ = _flat(rows["counts"])
    target = model.posterior(rows["pattern"].to_numpy(), rows["toxic"].to_numpy())
    parts = Classifier.features(rows["n_words"].to_numpy(), offsets, ids, counts, len(words))
    return words, Classifier.fit(len(rows), *parts, target, prior), seen


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Scores depend on the text alone. Null and empty texts have no hits and the score of such texts; repeated rows have
    equal scores; a null doc_id is never held out; without usable labels the fixed insults vote alone. Further columns
    of both tables are left out. Everything collected is bounded: mined words by the labelled sample, pattern counts by
    3 * 2 ** VOTERS, rows to train on by ``max_labelled`` (twice it, should doc_ids repeat); mining, votes and scores
    cover all rows.
    """
    words, classifier, seen = learned(docs, labels, max_labelled)
    weights = docs.sparkSession.sparkContext.broadcast(classifier.weights)  # a number for each word

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear = Classifier(weights.value)
        for batch in batches:
            ids, offsets = _flat(batch.column(2))
            counts, _ = _flat(batch.column(3))
            n_words = batch.column(1).to_numpy()
            parts = Classifier.features(n_words, offsets, ids, counts, len(weights.value) - 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(linear.scores(len(n_words), *parts))], names=["doc_id", "score"]
            )

    result = seen.select("doc_id", "n_words", "ids", "counts").mapInArrow(score, "doc_id bigint, score double")
    return result.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """The rows of ``docs``, same columns, whose score is below ``threshold``. Texts are scored where they are read, so
    none is shuffled."""
    words, classifier, _ = learned(docs, labels, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast((words, classifier.weights))
    text_at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(shared.value[0])}
        linear = Classifier(shared.value[1])
        for batch in batches:
            seen, sizes = [], []
            for text in batch.column(text_at):  # the words of one text at a time
                found = WORD.findall((text.as_py() or "").lower())
                seen.append(Counter(at[w] for w in found if w in at))
                sizes.append(len(found))
            ids = np.array([i for c in seen for i in c], dtype=np.int64)
            counts = np.array([n for c in seen for n in c.values()], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in seen], dtype=np.int64)])
            n_words = np.array(sizes, dtype=np.int64)
            parts = Classifier.features(n_words, offsets, ids, counts, len(at))
            yield batch.filter(pa.array(linear.scores(len(n_words), *parts) < threshold))

    return docs.mapInArrow(keep, docs.schema)

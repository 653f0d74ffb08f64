"""Toxicity by multiple-instance learning.

Labels are given for documents, offences happen in sentences.  A document is a bag of sentences,
each with probability sigmoid(b + sum of its words' weights); the document is toxic unless all of
its sentences are clean (noisy-or): 1 - prod(1 - p).  Training on document labels thus learns which
sentences are to blame, and the same model points at them.

* Features are words and beginnings of words (which stand for a family of inflected words).
  Documents with each of them are counted by label; the ``N_FEATURES`` whose counts differ most,
  by ``APART`` standard errors at least, are used.  Spark groups the counts; the driver gets the
  chosen ones only.
* Weights: gradient descent (Adam) on the log-loss of the bags.  Each pass runs over a written table
  of the labelled bags, whose tasks give one gradient each.
* At most ``MOST_LABELLED`` documents (those with the smallest md5 of their id) are learned from,
  which bounds this work at any corpus size.
* Scores of all whole texts are computed in Arrow batches; no text is shuffled.

Cases: null and empty texts are one empty sentence (score of the intercept); without labels of both
kinds every score is the share of toxic labels, 0 if there are none; a document with both labels is toxic; a null id is neither held out nor
labelled; repeated rows are scored alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .text import as_bytes, held_out, slices

THRESHOLD = 0.3
N_FEATURES = 2000
APART = 4.0
MIN_DOCUMENTS = 3
MOST_LABELLED = 30_000
PASSES = 40
RATE = 0.3
#: Weight of the squared weights, and the same over the number of documents, whichever is larger.
PENALTY, PENALTY_ROWS = 2e-4, 1.0
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)

#: Sentences end at these marks or at a line's end.
_SENTENCE = re.compile(rb"[^.!?\n]*(?:[.!?]+|\n|$)")
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff']+")


def sentences(text: bytes) -> list[tuple[int, bytes]]:
    """(start, bytes) of each sentence that has a word; one empty one if none has."""
    found = [(m.start(), m.group()) for m in _SENTENCE.finditer(text) if m.group() and _WORD.search(m.group())]
    return found or [(0, b"")]


def features(words: set[bytes]) -> set[bytes]:
    """Words, and beginnings of longer ones, marked by ^."""
    return words | {b"^" + w[:n] for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Model:
    words: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    constant: float | None = 0.0

    def __post_init__(self) -> None:
        self.begins = {w[1:5] for w in self.words if w[:1] == b"^"}

    def bag(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of sentences, and (start, length, feature) for each sentence and known word in it, once."""
        known = self.words
        found: list[tuple[int, int, int]] = []
        parts = sentences(text)
        for start, part in parts:
            words = set(_WORD.findall(part.lower()))
            hits = {known[w] for w in words if w in known}
            hits |= {known[b] for w in words if w[:4] in self.begins for n in BEGINNINGS if len(w) > n and (b := b"^" + w[:n]) in known}
            found.extend((start, len(part), f) for f in hits)
        return len(parts), found

    def margins(self, found: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
        out: dict[tuple[int, int], float] = {}
        for start, length, f in found:
            out[start, length] = out.get((start, length), self.intercept) + self.weights[f]
        return out

    def judge(self, text: bytes) -> tuple[float, int, int, float]:
        """Score of a text; start and length (bytes of UTF-8) of its worst sentence and that sentence's score."""
        if self.constant is not None:
            return self.constant, 0, 0, self.constant
        n, found = self.bag(text)
        margins = self.margins(found)
        clean = np.log1p(np.exp(self.intercept)) * (n - len(margins))
        worst = (0, 0, self.intercept)
        for (start, length), z in margins.items():
            clean += np.logaddexp(0, z)
            if z > worst[2]:
                worst = (start, length, z)
        return float(-np.expm1(-clean)), worst[0], worst[1], float(1 / (1 + np.exp(-worst[2])))


def document_words(docs: DataFrame) -> DataFrame:
    """toxic, word for each distinct feature of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [list(features(set(_WORD.findall(t.lower())))) for t in as_bytes(batch, "text")]
                sizes = np.array([len(x) for x in sets])
                toxic = np.repeat(np.asarray(batch.column("toxic"), np.int32), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array([w for x in sets for w in x], pa.binary())], names=["toxic", "word"])

    return docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(each, "toxic int, word binary")


def choose_words(labelled: DataFrame, n_toxic: int, n_clean: int, most: int = N_FEATURES) -> list[bytes]:
    counts = document_words(labelled).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.filter(F.col("t") + F.col("c") >= MIN_DOCUMENTS)
    share = (F.col("t") + F.col("c")) / F.lit(float(n_toxic + n_clean))
    error = F.sqrt(share * (1 - share + 1e-6) * (1 / n_toxic + 1 / n_clean))
    apart = F.abs(F.col("t") / F.lit(float(n_toxic)) - F.col("c") / F.lit(float(n_clean))) / error
    return [bytes(r["word"]) for r in counts.filter(apart >= APART).orderBy(apart.desc(), "word").limit(most).select("word").collect()]


def bags(labelled: DataFrame, model: Model) -> DataFrame:
    """toxic, n (sentences), sizes (known words of each sentence that has some), features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, sizes, features = [], [], []
                for text in as_bytes(batch, "text"):
                    count, found = model.bag(text)
                    starts = [s for s, _, _ in found]
                    n.append(count)
                    sizes.append(list(np.unique(starts, return_counts=True)[1]) if starts else [])
                    features.append([f for _, _, f in found])
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(features, pa.list_(pa.int32()))], names=["toxic", "n", "sizes", "features"])

    return labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(each, "toxic int, n int, sizes array<int>, features array<int>")


def gradient(table: DataFrame, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Sums over the bags: gradient by weight, by intercept, loss, bags."""
    d = len(weights)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 3)
        for batch in batches:
            y = np.asarray(batch.column("toxic"), np.float64)
            n = np.asarray(batch.column("n"), np.float64)
            sizes, features = batch.column("sizes"), batch.column("features")
            per_bag = np.diff(np.asarray(sizes.offsets))
            words = np.asarray(sizes.flatten())
            f = np.asarray(features.flatten())
            sentence = np.repeat(np.arange(len(words)), words)
            bag = np.repeat(np.arange(len(y)), per_bag)
            z = intercept + np.bincount(sentence, weights[f], minlength=len(words))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            empty = n - per_bag
            p0 = 1 / (1 + np.exp(-intercept))
            clean = np.bincount(bag, np.logaddexp(0, z), minlength=len(y)) + np.logaddexp(0, intercept) * empty
            toxic = np.maximum(-np.expm1(-clean), 1e-12)
            pull = np.where(y == 1, -np.exp(-clean) / toxic, 1.0)  # by the log-odds of a sentence, over its p
            by_sentence = pull[bag] * p
            total[:d] += np.bincount(f, by_sentence[sentence], minlength=d)
            total[d] += by_sentence.sum() + (pull * p0 * empty).sum()
            total[d + 1] += np.where(y == 1, -np.log(toxic), clean).sum()
            total[d + 2] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    # one vector a task; at most MOST_LABELLED documents bound the number of tasks
    return np.sum([np.array(r["g"]) for r in table.mapInArrow(part, "g array<double>").collect()], axis=0)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, passes: int = PASSES) -> Model:
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # more labels than the bound: those of the smallest md5 (a top-k, which tasks reduce before it is merged)
    known = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    # at most ``most`` pairs of numbers are broadcast, so that texts stay where they are
    labelled = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "labelled")
    counts = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, toxic = int(counts[0]), int(counts[1])
    if not 0 < toxic < n:
        return Model(constant=toxic / max(n, 1))
    words = choose_words(labelled, toxic, n - toxic)
    model = Model({w: i for i, w in enumerate(words)}, np.zeros(len(words)), float(np.log(toxic / n) - 3), None)
    table = staged(bags(labelled, model), "bags").coalesce(16)
    x = np.concatenate([model.weights, [model.intercept]])
    mean, square, penalty = np.zeros_like(x), np.zeros_like(x), np.full_like(x, max(PENALTY, PENALTY_ROWS / n))
    penalty[-1] = 0
    for i in range(1, passes + 1):
        g = gradient(table, x[:-1], float(x[-1]))
        slope = g[: len(x)] / max(g[-1], 1) + penalty * x
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        x = x - RATE * (1 - i / (passes + 1)) * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    model.weights, model.intercept = x[:-1], float(x[-1])
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, and the worst
    sentence: sentence_start, sentence_length (in bytes of the UTF-8 text), sentence_score."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [shared.value.judge(t) for t in as_bytes(batch, "text")]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "score", "sentence_start", "sentence_length", "sentence_score"])

    scores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, score double, sentence_start long, sentence_length long, sentence_score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentence_start", "sentence_length", "sentence_score")


def offending_sentences(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, score, sentence of every sentence at or above ``threshold``."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
                    if m.constant is None:
                        for (start, length), z in m.margins(m.bag(text)[1]).items():
                            p = float(1 / (1 + np.exp(-z)))
                            if p >= threshold:
                                rows.append((doc_id, start, length, p, text[start : start + length].decode("utf-8", "replace")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "score", "sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, start long, length long, score double, sentence string")

"""A quality classifier from trusted positives and unlabelled web text (PU learning).

Labels say "good" for some documents; the rest of the corpus is unlabelled, good and bad.  With
the share of good documents (the class prior, estimated below) the risk of a classifier f is

    prior * E_good[loss(f)] + max(0, E_all[loss(-f)] - prior * E_good[loss(-f)])

whose second part, the risk on bad documents, is kept from falling below zero (the non-negative
estimator): a step that would make it negative is taken back until it is not.

* Features are 40-odd figures about the shape of a text (letter cases, marks, repetition of words,
  word pairs, lines and their ends).  They are computed once, in Arrow batches, and written.
* The loss is logistic, the model linear in the standardised features and their squares.  Each
  Newton step is one pass: tasks sum gradients and curvature, the driver adds up d x d matrices.
* The prior is estimated from good and all documents, never from labels of bad ones: where scores of a first model
  are highest, bad documents are rare, and there the share of all documents over the share of good ones is the
  prior.  The lowest such ratio, plus its standard error, is taken over the score thresholds that enough of the good
  documents reach.

All positives and all documents enter; nothing is sampled.

Cases: null and empty texts get the score of their features (all zero); no positive label at all
gives the prior's default as every score; a null id is never held out nor labelled; repeated rows
are scored alike; an empty table gives an empty result; other columns are not looked at.
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

from .staging import staged
from .text import as_bytes, held_out, slices, text_digest, whole_row

THRESHOLD = 0.7
STEPS = 10
#: Weight of the squared weights, and what it is at least as a number of rows over the good ones.
RIDGE, RIDGE_ROWS = 1e-3, 2.0
#: Prior before anything is known, and bounds within which it is estimated.
PRIOR_DEFAULT, PRIOR_LOW, PRIOR_HIGH = 0.5, 0.05, 0.98
#: Score thresholds count for the prior if so many of the good documents reach them.
PRIOR_SHARE = 0.4
BINS = 400
#: Tasks that add up the vectors of all tasks.
ADDERS = 8

_LINE_END = b".!?:;)\"'"
_RUN = re.compile(rb"([^\sA-Za-z0-9\x80-\xff])\1+")
_CLASSES = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _CLASSES[_c] = 1 if "a" <= _ch <= "z" or _c >= 128 else 2 if "A" <= _ch <= "Z" else 3 if _ch.isdigit() and _c < 128 else 4 if _ch in " \t\r\x0b\x0c" else 5 if _ch == "\n" else 6 if _ch in ".,;:'\"-()?" else 7


def packed_size(text: bytes) -> int:
    """Compressed bytes of the whole text, which is fed in blocks so that the output is never held at once."""
    packer, view = zlib.compressobj(1), memoryview(text)
    return sum(len(packer.compress(view[i : i + 65536])) for i in range(0, len(text), 65536)) + len(packer.flush())


def features(text: bytes) -> list[float]:
    """Figures about the shape of a UTF-8 text; a list of ten short words of several languages is one of them."""
    n = len(text)
    if not n:
        return [0.0] * N_FEATURES
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=8)
    letters = max(int(kinds[1] + kinds[2]), 1)
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    line_counts = Counter(lines)
    upper = sum(map(bytes.isupper, words))
    starts = sum(x[:1].isupper() for x in words)
    plain = sum(map(bytes.isalpha, words))
    marks = Counter(x[-1:] for x in words)
    odd_end = sum(c for x, c in marks.items() if _CLASSES[x[0]] == 7 and x[0] != 33)
    bang = marks.get(b"!", 0)
    top = counts.most_common(3)
    packed = packed_size(text) / n
    digits = [c for c in range(48, 58)]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        kinds[2] / letters, kinds[3] / n, kinds[5] / n * 20, kinds[6] / n * 10, min(kinds[7] / n * 10, 5),
        letters / n, float(lengths.mean()) / 10, float(lengths.std()) / 10, float(lengths.max()) / 50,
        len(counts) / w, len(pairs) / w, same / w,
        upper / w, starts / w, plain / w, odd_end / w, bang / w,
        top[0][1] / w if top else 0.0, sum(c for _, c in top) / w,
        sum(len(x) * c for x, c in line_counts.items() if c > 1) / n, len(line_counts) / m,
        sum(x.rstrip()[-1] in _LINE_END for x in lines) / m,
        sum(x[:1] in b"-*#|>" or x[:1] == b"\xe2" for x in lines) / m,
        np.log1p(n / m), packed, min(len(_RUN.findall(text)) / w, 1.0),
        text.count(b"|") / w, text.count(b"<") / w, text.count(b"{") / w, text.count(b"http") / w * 10, text.count(b"@") / w * 10,
        sum(text.count(bytes([d])) for d in digits) / w, text.count(b"...") / w,
        marks.get(b".", 0) / w * 5, marks.get(b",", 0) / w * 5, sum(x in (b"the", b"de", b"der", b"la", b"and", b"of", b"die", b"que", b"et", b"y") for x in words) / w * 5,
        text.count(b"\xc2") / n + text.count(b"\xef\xbf\xbd") / n * 10,
    ]


N_FEATURES = 40


def document_features(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, x (array of float) and the ``carried`` columns for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    more = rows.columns[2:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = np.array([features(t) for t in as_bytes(batch, "text")], np.float32).reshape(batch.num_rows, N_FEATURES)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *(batch.column(c) for c in more)], names=["doc_id", "x", *more])

    return rows.mapInArrow(each, ", ".join(["doc_id long, x array<float>", *(f"{c} {t}" for c, t in rows.dtypes[2:])]))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1)


def _summed(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of the vectors that ``part`` (RecordBatch -> vector) gives.

    One vector a task, added up by ``ADDERS`` tasks before the driver adds theirs.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    vectors = df.mapInArrow(partial, "v array<double>").repartition(ADDERS).mapInArrow(added, "v array<double>")
    return np.sum([np.array(r["v"]) for r in vectors.collect()], axis=0) + np.zeros(size)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """1, standardised features (clipped at 6) and their squares."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _pass(table: DataFrame, model: Model) -> dict:
    """One pass over ``table`` (x, good): mean loss(-f) over all rows and over the good ones, with gradient and curvature of
    each, and the mean design of the good ones."""
    d = len(model.weights)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        a = model.design(_matrix(batch))
        f = a @ model.weights
        p, loss, good = sigmoid(f), softplus(f), np.asarray(batch.column("good"))
        sums = [[len(a), good.sum()]]
        for rows, q, lost in ((a, p, loss), (a[good], p[good], loss[good])):
            sums += [[lost.sum()], q @ rows, ((rows * (q * (1 - q))[:, None]).T @ rows).ravel()]
        return np.concatenate([*sums, a[good].sum(0)])

    s = _summed(table, part, 2 + 2 * (1 + d + d * d) + d)
    n, m = max(s[0], 1), max(s[1], 1)
    out: dict = {"n_good": s[1], "good_mean": s[-d:] / m}
    for i, (name, over) in enumerate((("all", n), ("good", m))):
        own = s[2 + i * (1 + d + d * d) :] / over
        out[name], out[f"{name}_slope"], out[f"{name}_curve"] = own[0], own[1 : 1 + d], own[1 + d : 1 + d + d * d].reshape(d, d)
    return out


def train(table: DataFrame, prior: float | None = None, steps: int = STEPS) -> Model | None:
    """Fit on ``table`` (x, good) of all documents, the trusted ones marked good; None without any good one."""
    sums = _summed(table, lambda b: (lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))(_matrix(b)), 1 + 2 * N_FEATURES)
    n = max(sums[0], 1)
    mean = sums[1 : 1 + N_FEATURES] / n
    scale = np.sqrt(np.maximum(sums[1 + N_FEATURES :] / n - mean**2, 1e-8))
    model = Model(mean, scale, np.zeros(1 + 2 * N_FEATURES), prior or PRIOR_DEFAULT)
    if prior is None:
        # a first model tells good from all; its scores order documents, which is enough for the prior
        model = _descend(table, model, max(steps // 3, 3))
        if model is None:
            return None
        model.prior = _prior(table, model)
    return _descend(table, model, steps)


def risk(model: Model, at: dict, ridge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk, its slope and its curvature, from the sums of ``_pass``.

    The good documents' part is prior * E_good[loss(f)], with loss(f) = loss(-f) - f.  The bad ones' part,
    E_all[loss(-f)] - prior * E_good[loss(-f)], counts as zero, with no slope, where it is below zero.  Where it counts,
    the curvatures of loss(-f) on good documents cancel.
    """
    prior, w = model.prior, model.weights
    on_good, bad = at["good"] - float(at["good_mean"] @ w), at["all"] - prior * at["good"]
    value = prior * on_good + max(0.0, bad) + 0.5 * float(ridge @ w**2)
    if bad >= 0:
        return value, at["all_slope"] - prior * at["good_mean"] + ridge * w, at["all_curve"] + np.diag(ridge)
    return value, prior * (at["good_slope"] - at["good_mean"]) + ridge * w, prior * at["good_curve"] + np.diag(ridge)


def _descend(table: DataFrame, model: Model, steps: int) -> Model | None:
    """Newton steps on the risk, one pass each, and another where a step is halved until the risk falls."""
    d = len(model.weights)
    now = _pass(table, model)
    if not now["n_good"]:
        return None
    ridge = np.full(d, max(RIDGE, RIDGE_ROWS / now["n_good"]))
    ridge[0] = 0
    value, slope, curve = risk(model, now, ridge)
    for _ in range(steps):
        step = np.linalg.solve(curve + 1e-6 * np.eye(d), slope)
        for size in (1.0, 0.5, 0.2):
            tried = Model(model.mean, model.scale, model.weights - size * step, model.prior)
            new = risk(tried, _pass(table, tried), ridge)
            if new[0] < value:
                break
        else:
            return model
        settled = value - new[0] < 1e-4
        model, (value, slope, curve) = tried, new
        if settled:
            return model
    return model


def _prior(table: DataFrame, model: Model) -> float:
    """Lowest ratio of the shares of all and of good documents above a score, each plus the standard error that
    the number of good documents above that score gives it (without which the lowest of noisy ratios is too low)."""

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((np.clip(model.margin(_matrix(batch)), -10, 10) + 10) / 20 * BINS, 0, BINS - 1).astype(int)
        good = np.asarray(batch.column("good"))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[good], minlength=BINS)])

    counts = _summed(table, bins, 2 * BINS)
    every, some = counts[:BINS][::-1].cumsum(), counts[BINS:][::-1].cumsum()
    share_all, share_good = every / max(every[-1], 1), some / max(some[-1], 1)
    enough = share_good >= PRIOR_SHARE
    share, good = share_good[enough], max(some[-1], 1)
    ratio = share_all[enough] / share * (1 + np.sqrt((1 - share) / (share * good)))
    return float(np.clip(ratio.min(initial=PRIOR_HIGH), PRIOR_LOW, PRIOR_HIGH))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the ``carried`` columns for each row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality): quality 1 marks the trusted good documents, unless held out.
    """
    trusted = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = trusted.select("doc_id", F.lit(True).alias("good")).distinct()
    found = document_features(docs, *carried)
    more = found.columns[2:]
    table = staged(found.join(trusted, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))), "features")
    model = train(table)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if model else np.full(batch.num_rows, PRIOR_DEFAULT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), *(batch.column(c) for c in more)], names=["doc_id", "score", *more])

    kinds = dict(found.dtypes)
    scores = table.select("doc_id", "x", *more).mapInArrow(each, ", ".join(["doc_id long, score double", *(f"{c} {kinds[c]}" for c in more)]))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that are not rejected, told apart by id and digest of the text: null and repeated ids are rows like any other."""
    rejected = scored(docs, labels, threshold, (text_digest(F.col("text")).alias("digest"),)).filter("predicted = 0")
    rejected = rejected.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest")).distinct()
    marked = docs.select(whole_row(docs), "doc_id", text_digest(F.col("text")).alias("digest"))
    return marked.join(rejected, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left_anti").select("row.*")

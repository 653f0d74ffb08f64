"""Generalised linear models trained by full-batch gradient descent.

A model is a pair of a link and a loss in ``z = w[0] + w[1:] * x``; the gradient of a row is
``residual * (1, x)``.  Partial gradients are sums, so those of any partitioning add up to the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, log_loss, sigmoid

EPS = 1e-12


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _log_loss(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, EPS, 1 - EPS)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


@dataclass(frozen=True)
class GlmModel:
    """``column`` and ``column_loss`` work on columns, ``block`` and ``block_loss`` on arrays."""

    name: str
    classifier: bool
    column: Callable[[Column], Column]
    column_loss: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray], np.ndarray]
    block_loss: Callable[[np.ndarray, np.ndarray], np.ndarray]


LOGISTIC = GlmModel("logistic", True, sigmoid, log_loss, _sigmoid, _log_loss)
LINEAR = GlmModel("linear", False, lambda z: z, lambda p, y: (p - y) * (p - y) / 2, lambda z: z, lambda p, y: (p - y) ** 2 / 2)

#: The models of a cohort by name.
MODELS = {"mortality": LOGISTIC, "survival": LINEAR, "cost": LINEAR}


def model_named(name: str) -> GlmModel:
    if name not in MODELS:
        raise KeyError(f"no model {name!r}; there are {', '.join(MODELS)}")
    return MODELS[name]


def gradient_state(df: DataFrame, model: GlmModel, weights: Sequence[float], xs: Sequence[str], y: str) -> DataFrame:
    """One row: g (array), loss (sum), n.  SQL sums; for tables whose plan is to stay one query."""
    z = dot(weights, [F.col(x) for x in xs])
    rows = df.select(z.alias("_z"), F.col(y).alias("_y"), *xs).withColumn("_p", model.column(F.col("_z")))
    residual = F.col("_p") - F.col("_y")
    sums = [F.sum(residual), *(F.sum(residual * F.col(x)) for x in xs)]
    return rows.agg(F.array(*sums).alias("g"), F.sum(model.column_loss(F.col("_p"), F.col("_y"))).alias("loss"), F.count("*").alias("n"))


#: Rows of a block: 8 MB at a dozen columns of many values.
BLOCK_ROWS = 65_536
#: Values of a column of a block up to which each is kept once, and a byte a row.
FEW = 256


def blocks(df: DataFrame, xs: Sequence[str], ys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(n, cells): the rows of ``df`` as matrices of (1, xs, ys), one a block, for passes that read all columns of all rows.

    A block is one value of the table, so keeping, spilling and handing it on cost nothing a row.  The ones are not kept, and
    a column of few values takes a byte a row.
    """
    columns = [*xs, *ys]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            a = np.empty((len(columns), batch.num_rows))
            for i in range(len(columns)):
                a[i] = np.asarray(batch.column(i))
            held.append(a)
            if sum(a.shape[1] for a in held) >= rows:
                yield _block(held)
                held = []
        if held:
            yield _block(held)

    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(pack, "n long, cells binary")


def _block(parts: list[np.ndarray]) -> pa.RecordBatch:
    a = np.concatenate(parts, axis=1)
    return pa.RecordBatch.from_arrays([pa.array([a.shape[1]], pa.int64()), pa.array([_packed(a)], pa.binary())], names=["n", "cells"])


def _packed(columns: np.ndarray) -> bytes:
    """For each row of ``columns`` its number of values (0: many), then the values or the whole row, then a byte a cell for those of few."""
    counts, values, codes = [], [], []
    for column in columns:
        few = len(np.unique(column[: 4 * FEW])) <= FEW
        code, known = pd.factorize(column, use_na_sentinel=False) if few else ((), column)
        few = few and len(known) <= FEW
        counts.append(len(known) if few else 0)
        values.append(known if few else column)
        codes.append(code.astype(np.uint8) if few else np.empty(0, np.uint8))
    return b"".join([np.array(counts, np.int64).tobytes(), *(np.ascontiguousarray(v).tobytes() for v in values), *(c.tobytes() for c in codes)])


def _unpacked(cells: pa.Buffer, n: int, width: int) -> np.ndarray:
    """The matrix of a block: a column of ones, then those that ``_packed`` was given."""
    a = np.empty((width, n))
    a[0] = 1
    counts = np.frombuffer(cells, np.int64, width - 1)
    at = 8 * (width - 1)
    code = at + 8 * int(np.where(counts > 0, counts, n).sum())
    for i, k in enumerate(counts.tolist(), 1):
        values = np.frombuffer(cells, np.float64, k or n, at)
        at += 8 * len(values)
        if k:
            np.take(values, np.frombuffer(cells, np.uint8, n, code), out=a[i], mode="clip")
            code += n
        else:
            a[i] = values
    return a.T


def _block_sums(packed: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all blocks of the ``size`` numbers that ``add`` makes of one; tasks add up theirs, Spark adds up the tasks'."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for n, cells in zip(batch.column("n").to_pylist(), batch.column("cells"), strict=True):
                total += add(_unpacked(cells.as_buffer(), n, width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    sums = packed.mapInArrow(partial, "s array<double>").agg(*(F.sum(F.col("s")[i]) for i in range(size))).first()
    return np.array([x or 0.0 for x in sums])


def block_gram(packed: DataFrame, width: int) -> np.ndarray:
    """Sum over the rows of ``blocks`` of a * a', a = (1, xs, ys): one pass for all linear models and targets."""
    return _block_sums(packed, width * width, lambda a: (a.T @ a).ravel(), width).reshape(width, width)


def block_gradients(packed: DataFrame, d: int, width: int, models: Sequence[tuple[GlmModel, int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums of gradients by model, sums of losses, rows) of several models in one pass over ``blocks``.

    ``models`` gives each one's place among the targets, ``weights`` a row of ``d`` weights for each.
    """

    def add(a: np.ndarray) -> np.ndarray:
        x, out = a[:, :d], []
        z = x @ weights.T
        for j, (model, at) in enumerate(models):
            y, p = a[:, d + at], model.block(z[:, j])
            out += [*((p - y) @ x), model.block_loss(p, y).sum()]
        return np.array([*out, len(a)])

    total = _block_sums(packed, len(models) * (d + 1) + 1, add, width)
    each = total[:-1].reshape(len(models), d + 1)
    return each[:, :d], each[:, d], int(total[-1])


def gradient(df: DataFrame, model: GlmModel, weights: np.ndarray, xs: Sequence[str], y: str) -> tuple[np.ndarray, float, int]:
    """(sum of gradients, sum of losses, rows) of one model over rows that are not in blocks yet."""
    d = len(xs) + 1
    g, loss, n = block_gradients(blocks(df, xs, [y]), d, d + 1, [(model, 0)], np.atleast_2d(weights))
    return g[0], float(loss[0]), n


def mean_gradient(total: np.ndarray, loss: float, n: int, weights: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Mean gradient, with the penalty on all weights but the bias, and mean loss, without it."""
    if not n:
        return np.zeros_like(weights), 0.0
    g = total / n
    g[1:] += l2 * weights[1:]
    return g, loss / n


def train(df: DataFrame, model: GlmModel, xs: Sequence[str], y: str, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss before each step of one model."""
    return train_all(df, {y: (model, y)}, xs, epochs, rate, l2)[y]


def train_all(df: DataFrame, models: Mapping[str, tuple[GlmModel, str]], xs: Sequence[str], epochs: int, rate: float, l2: float) -> dict[str, tuple[np.ndarray, list[float]]]:
    """Weights and the loss before each step, by name, of models (and their targets) with the same features.

    Rows are packed into blocks once, which are kept in memory or on disk; what is lost is packed again.  Linear models
    need one pass for all epochs, in which all of their targets are met; the others share one pass an epoch.
    """
    ys = list(dict.fromkeys(y for _, y in models.values()))
    d, width = len(xs) + 1, len(xs) + 1 + len(ys)
    packed = blocks(df, xs, ys).persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        linear = {name: ys.index(y) for name, (model, y) in models.items() if model is LINEAR}
        if linear:
            m = block_gram(packed, width)
            for name, at in linear.items():
                out[name] = _train_linear(m[0, 0], m[:d, :d], m[:d, d + at], m[d + at, d + at], epochs, rate, l2)
        others = {name: (model, ys.index(y)) for name, (model, y) in models.items() if model is not LINEAR}
        if others:
            weights, histories = np.zeros((len(others), d)), [[] for _ in others]
            for _ in range(epochs):
                g, losses, n = block_gradients(packed, d, width, list(others.values()), weights)
                steps = [mean_gradient(g[j], losses[j], n, weights[j], l2) for j in range(len(others))]
                for history, (_, mean_loss) in zip(histories, steps, strict=True):
                    history.append(float(mean_loss))
                weights = weights - rate * np.array([step for step, _ in steps])
            out |= {name: (weights[j], histories[j]) for j, name in enumerate(others)}
    finally:
        packed.unpersist()
    return out


def _train_linear(n: float, xx: np.ndarray, xy: np.ndarray, yy: float, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, list[float]]:
    weights, history = np.zeros(len(xy)), []
    for _ in range(epochs):
        loss = 0.5 * float(weights @ xx @ weights - 2 * weights @ xy + yy)
        g, mean_loss = mean_gradient(xx @ weights - xy, loss, int(n), weights, l2)
        history.append(mean_loss)
        weights = weights - rate * g
    return weights, history

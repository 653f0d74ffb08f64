"""Profiles with mergeable state, counts, histograms, correlations and Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n", "nulls", "mean", "m2", "min", "max")
STATE_SCHEMA = "col string, n long, nulls long, mean double, m2 double, min double, max double"


def profile_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: col, n, nulls, mean, m2 (sum of squared deviations from the mean), min, max.

    One pass; tasks keep centred moments and Spark merges them pairwise, so an offset common to all values costs no digits.
    """
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x), F.count_if(x.isNull()), F.avg(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x)]
    flat = df.agg(*(a.alias(f"_{i}") for i, a in enumerate(aggs)))
    k = len(STATE)
    rows = F.array(*(F.struct(F.lit(c).alias("col"), *(F.col(f"_{i * k + j}").alias(s) for j, s in enumerate(STATE))) for i, c in enumerate(columns)))
    return flat.select(F.inline(rows))


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same column, of any number of batches, as one.

    The mean of the whole comes first; then each batch adds its own deviations and those of its mean from that mean.  So
    nothing large is subtracted, and states of states may be merged again in any order.
    """
    means = states.groupBy("col").agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    m2 = F.sum(F.col("m2") + F.col("n") * apart * apart)
    return states.join(means, "col").groupBy("col").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.first("_mean").alias("mean"), m2.alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))


def finish_profile(states: DataFrame) -> DataFrame:
    """col, n, nulls, null_pct, mean, variance, std, min, max.

    The variance is the sample variance; 0 for one value, null (like all moments) for none.
    """
    n = F.col("n")
    total = n + F.col("nulls")
    variance = F.when(n > 1, F.col("m2") / (n - 1)).when(n == 1, F.lit(0.0))
    return states.select(
        "col", "n", "nulls",
        F.when(total > 0, F.col("nulls") / total * 100).otherwise(0.0).alias("null_pct"),
        "mean", variance.alias("variance"), F.sqrt(variance).alias("std"),
        "min", "max",
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Profile in one pass."""
    return finish_profile(profile_state(df, columns))


def count_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows for each key; null keys are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def sum_per_key(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(name))


def mean_per_key(df: DataFrame, key: str, keep: Column, value: Column, name: str) -> DataFrame:
    """Mean of ``value`` over the rows to keep, nulls ignored."""
    return df.filter(keep & F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias(name))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 below, 1..bins, bins + 1 at and above high), n."""
    bin = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(column).isNotNull()).groupBy(bin.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def category_frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, n, share; the total is taken over the few grouped rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sum over rows of a * a', a = (1, columns): tasks multiply blocks, partial matrices are added up by Spark."""
    d = len(columns) + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            a = np.ones((batch.num_rows, d))
            for i in range(d - 1):
                a[:, i + 1] = np.asarray(batch.column(i))
            total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    out = np.zeros(d * d)
    for cell, value in doubles.mapInArrow(blocks, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out.reshape(d, d)


def gram_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The Gram matrix as rows (row, col, value), upper half."""
    names = ["1", *columns]
    g = gram_matrix(df, columns)
    rows = [(names[i], names[j], float(g[i, j])) for i in range(len(names)) for j in range(i, len(names))]
    return df.sparkSession.createDataFrame(rows, "row string, col string, value double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = df.agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return flat.select(F.inline(rows))


def partition_load(df: DataFrame) -> DataFrame:
    """Rows for each partition as Spark deals them."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def duplicate_key_rate(df: DataFrame, key: Column) -> DataFrame:
    """requests, misses (distinct keys), hits and their share; keys are grouped before they are counted."""
    counts = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("requests"), F.count("*").alias("misses")).select(
        "requests", "misses", (F.col("requests") - F.col("misses")).alias("hits"),
        F.when(F.col("requests") > 0, (F.col("requests") - F.col("misses")) / F.col("requests")).otherwise(0.0).alias("hit_share"),
    )

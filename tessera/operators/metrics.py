"""Metrics of classifiers and regressors as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import log_loss
from .ranks import PART_ROWS, placed


def average_ranks(df: DataFrame, score: str, y: str, part_rows: int = PART_ROWS) -> DataFrame:
    """score, n, positives, rank: the average rank (from 1) of all rows with that score.

    Rows are grouped by score first.  Distinct scores are then placed in ranges, as many as their number asks for, so it
    makes no difference whether there are eleven scores or one for each row.
    """
    grouped = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("positives"))
    ranked = placed(grouped, ["score"], "n", part_rows)
    return ranked.select("score", "n", "positives", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def auc(df: DataFrame, score: str, y: str, part_rows: int = PART_ROWS) -> DataFrame:
    """One row, auc: chance that a positive is ranked above a negative; 0.5 with a single class."""
    ranks = average_ranks(df, score, y, part_rows)
    sums = ranks.agg(F.sum(F.col("positives") * F.col("rank")).alias("r"), F.sum("positives").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    value = (F.col("r") - p * (p + 1) / 2) / (p * n)
    return sums.select(F.when((p > 0) & (n > 0), value).otherwise(0.5).alias("auc"))


def classification_metrics(df: DataFrame, score: str, y: str) -> DataFrame:
    """One row: accuracy (at 0.5), log_loss; zeros for no rows."""
    p, t = F.col(score), F.col(y).cast("double")
    right = ((p >= 0.5) == (t == 1)).cast("double")
    return df.agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(log_loss(p, t)), F.lit(0.0)).alias("log_loss"))


def regression_metrics(df: DataFrame, predicted: str, y: str) -> DataFrame:
    """One row: rmse, mae, r2 (0 for a constant target); zeros for no rows."""
    e = F.col(predicted) - F.col(y)
    total = F.count("*") * F.var_pop(F.col(y).cast("double"))
    return df.agg(
        F.coalesce(F.sqrt(F.avg(e * e)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.when(total > 0, 1 - F.sum(e * e) / total), F.lit(0.0)).alias("r2"),
    )

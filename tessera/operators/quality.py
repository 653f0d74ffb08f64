"""Validation, defaults and reject accounting of raw (all-string) cohort rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalized, to_double, to_flag, to_long, trimmed

MAX_AGE = 120
MAX_PSA = 200.0


def reject_reason(id: Column, age: Column, psa: Column) -> Column:
    """Why a raw row is rejected, null if it is valid.

    A measurement that reads as NaN is no number outside the bounds and passes.
    """
    years, level = to_long(age), to_double(psa)
    return (
        F.when(trimmed(id) == "", "id")
        .when(years.isNull() | (years < 0) | (years > MAX_AGE), "age")
        .when(level.isNull() | (level < 0) | ((level > MAX_PSA) & ~F.isnan(level)), "psa")
    )


def typed_rows(raw: DataFrame) -> DataFrame:
    """Valid rows of a raw cohort table, typed; optional numbers that don't parse are 0."""
    return _typed(raw.filter(reject_reason(F.col("id"), F.col("age"), F.col("psa")).isNull()))


def _typed(valid: DataFrame) -> DataFrame:
    def number(c: str) -> Column:
        return F.coalesce(to_double(F.col(c)), F.lit(0.0)).alias(c)

    def whole(c: str) -> Column:
        return F.coalesce(to_long(F.col(c)), F.lit(0).cast("bigint")).alias(c)

    return valid.select(
        trimmed(F.col("id")).alias("id"),
        to_long(F.col("age")).alias("age"),
        *(normalized(F.col(c)).alias(c) for c in ("race", "ethnicity", "marital")),
        *(number(c) for c in ("income", "coverage", "healthcare_cost", "psa")),
        *(whole(c) for c in ("num_encounters", "num_diagnoses")),
        to_flag(F.col("has_died")).alias("has_died"),
        whole("survival_days"),
    )


def reject_counts(raw: DataFrame) -> DataFrame:
    """reason ("valid" for rows that pass), n."""
    reason = F.coalesce(reject_reason(F.col("id"), F.col("age"), F.col("psa")), F.lit("valid"))
    return raw.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


REASONS = ("id", "age", "psa")


def typed_rows_counted(raw: DataFrame, name: str = "rejects") -> tuple[DataFrame, Observation]:
    """``typed_rows`` and an observation of the same pass: rows, valid, and the rejected ones by reason.

    The counts travel with the tasks that read the rows; they are there once an action has run over all of the result (what it
    does with it makes no difference), and take no scan of their own.
    """
    marked = raw.withColumn("_reason", reject_reason(F.col("id"), F.col("age"), F.col("psa")))
    counted = Observation(name)
    counts = [F.count_if(F.col("_reason") == r).alias(r) for r in REASONS]
    seen = marked.observe(counted, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_reason").isNull()).alias("valid"), *counts)
    return _typed(seen.filter(F.col("_reason").isNull())), counted


def observed_counts(spark: SparkSession, counted: Observation) -> DataFrame:
    """The observation as ``reject_counts`` gives it: (reason, n) of what occurs."""
    found = counted.get
    rows = [(reason, found[reason]) for reason in ("valid", *REASONS) if found.get(reason)]
    return spark.createDataFrame(rows, "reason string, n long")


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that gives null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def request_rules(strict_required: bool = False) -> dict[str, Column]:
    """Rules for scoring requests.  ``strict_required`` also rejects a 0 in required numbers."""

    def at_least(c: str, low: float, strict: bool = False) -> Column:
        return F.col(c) > low if strict else F.col(c) >= low

    return {
        "age": at_least("age", 0, strict_required) & (F.col("age") <= MAX_AGE),
        "income": at_least("income", 0, strict_required),
        "psa": at_least("psa", 0, strict_required),
        "coverage": F.col("coverage").between(0, 1),
    }

"""A labelled synthetic cohort whose values depend on seed and row number only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal, sigmoid, uniform
from ..spec import COHORT


def synthetic_cohort(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One patient for each row of ``keys``; the risk, survival and cost follow the other columns."""
    k = F.col(key)

    def u(name: str):
        return uniform(seed, name, k)

    base = keys.select(
        F.format_string("PAT-%07d", k.cast("bigint")).alias("id"),
        k.alias("_key"),
        (45 + F.floor(40 * u("age"))).cast("bigint").alias("age"),
        F.element_at(F.array(*(F.lit(r) for r in COHORT.categories)), (F.floor(5 * u("race")) + 1).cast("int")).alias("race"),
        (20000 + 80000 * u("income")).alias("income"),
        (0.4 + 0.6 * u("coverage")).alias("coverage"),
        (20 * u("psa")).alias("psa"),
        (1 + F.floor(30 * u("encounters"))).cast("bigint").alias("num_encounters"),
        (1 + F.floor(8 * u("diagnoses"))).cast("bigint").alias("num_diagnoses"),
    )
    age, psa, income, coverage, visits, diagnoses = (F.col(c) for c in ("age", "psa", "income", "coverage", "num_encounters", "num_diagnoses"))
    dying = sigmoid(-6 + 0.05 * age + 0.12 * psa + 0.2 * diagnoses - 2e-5 * income)
    survival = 4200 - 18 * age - 90 * psa + 1500 * coverage + 200 * normal(seed, "survival", F.col("_key"))
    cost = 6000 + 1500 * psa + 600 * visits + 2200 * diagnoses + 0.05 * income + 1500 * normal(seed, "cost", F.col("_key"))
    return base.select(
        "id", "age", "race", "income", "coverage", "psa", "num_encounters", "num_diagnoses",
        (uniform(seed, "died", F.col("_key")) < dying).alias("has_died"),
        F.greatest(F.lit(90.0), survival).cast("bigint").alias("survival_days"),
        F.greatest(F.lit(0.0), cost).alias("healthcare_cost"),
    )


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return synthetic_cohort(spark.range(n), "id", seed)

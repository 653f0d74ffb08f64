"""From raw clinical extracts to one flat cohort table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip, contains_ci, count_non_null, normal, to_double
from ..operators.aggregates import count_per_key, mean_per_key, sum_per_key
from ..operators.joins import left_join_lookups
from ..sources.files import first_existing

DEFAULT_AGE = 68.0
LEVEL_MEAN, LEVEL_SIGMA = 1.5, 0.6
LEVEL_LOW, LEVEL_HIGH = 0.1, 200.0
LEVEL_TEXT = "Prostate specific"


def age_years(birth: Column, as_of: Column) -> Column:
    """Whole years at ``as_of``, rounded half to even; unknown birth counts as the default age."""
    years = F.coalesce(F.datediff(as_of, birth) / 365.25, F.lit(DEFAULT_AGE))
    return F.bround(clip(years, 0.0, 120.0)).cast("bigint")


def survival_days(birth: Column, death: Column, as_of: Column) -> Column:
    days = F.datediff(F.coalesce(death, as_of), birth).cast("bigint")
    return F.greatest(F.coalesce(days, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def imputed_level(level: Column, key: Column, seed: int | str = 42) -> Column:
    """A missing level is drawn from a log-normal distribution, by key; then clipped and rounded."""
    drawn = F.exp(LEVEL_MEAN + LEVEL_SIGMA * normal(seed, "level", key))
    return F.bround(clip(F.coalesce(level, drawn), LEVEL_LOW, LEVEL_HIGH), 2)


def diagnosis_columns(df: DataFrame, prefix: str = "DIAGNOSIS") -> Sequence[str]:
    return [c for c in df.columns if c.upper().startswith(prefix)]


def diagnosis_counts(conditions: DataFrame | None, claims: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(patient, num_diagnoses) from conditions, else from the diagnosis columns of claims, else none."""
    if conditions is not None:
        return count_per_key(conditions, "PATIENT", "num_diagnoses").withColumnRenamed("PATIENT", "patient")
    if claims is not None:
        key = "PATIENTID" if "PATIENTID" in claims.columns else "PATIENT"
        columns = diagnosis_columns(claims)
        if columns and key in claims.columns:
            return sum_per_key(claims, key, count_non_null([F.col(c) for c in columns]), "num_diagnoses").withColumnRenamed(key, "patient")
    return spark.createDataFrame([], "patient string, num_diagnoses bigint")


def diagnosis_source(spark: SparkSession, folder: str) -> str | None:
    """Path of the extract that diagnoses are counted from."""
    return first_existing(spark, [f"{folder}/conditions.csv", f"{folder}/claims.csv"])


def cohort_table(patients: DataFrame, encounters: DataFrame, observations: DataFrame, diagnoses: DataFrame, as_of: Column, seed: int | str = 42) -> DataFrame:
    """The 13 columns of the cohort: three lookups joined to the patients, defaults, derived values."""
    visits = count_per_key(encounters, "PATIENT", "num_encounters")
    levels = mean_per_key(observations, "PATIENT", contains_ci(F.col("DESCRIPTION"), LEVEL_TEXT), to_double(F.col("VALUE")), "level")
    joined = left_join_lookups(patients, "Id", [visits, diagnoses, levels], {"num_encounters": 0, "num_diagnoses": 0})
    birth, death = F.col("BIRTHDATE"), F.col("DEATHDATE")

    def money(c: str, digits: int) -> Column:
        return F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), digits)

    return joined.select(
        F.col("Id").alias("id"),
        age_years(birth, as_of).alias("age"),
        F.coalesce(F.lower("RACE"), F.lit("other")).alias("race"),
        F.coalesce(F.lower("ETHNICITY"), F.lit("unknown")).alias("ethnicity"),
        F.coalesce(F.lower("MARITAL"), F.lit("s")).alias("marital"),
        money("INCOME", 2).alias("income"),
        money("HEALTHCARE_COVERAGE", 4).alias("coverage"),
        money("HEALTHCARE_EXPENSES", 2).alias("healthcare_cost"),
        imputed_level(F.col("level"), F.col("Id"), seed).alias("psa"),
        F.col("num_encounters").cast("bigint").alias("num_encounters"),
        F.col("num_diagnoses").cast("bigint").alias("num_diagnoses"),
        death.isNotNull().alias("has_died"),
        survival_days(birth, death, as_of).alias("survival_days"),
    )

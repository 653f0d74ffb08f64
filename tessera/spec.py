"""What the columns of a table mean to the models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.columns import one_hot


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    continuous: tuple[str, ...]
    category: str
    categories: tuple[str, ...]
    fallback: str
    binary_target: str
    continuous_targets: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        """Feature names, continuous ones first, then one for each category."""
        return [*self.continuous, *(f"{self.category}_{i}" for i in range(len(self.categories)))]

    def features(self) -> list[Column]:
        values = [F.col(c).cast("double") for c in self.continuous]
        values += one_hot(F.col(self.category), self.categories, self.fallback)
        return [v.alias(n) for v, n in zip(values, self.names, strict=True)]

    def targets(self) -> list[Column]:
        return [F.col(t).cast("double").alias(t) for t in (self.binary_target, *self.continuous_targets)]


#: The cohort table; the cost of care is a target and so no feature.
COHORT = FeatureSpec(
    id="id",
    continuous=("age", "psa", "income", "coverage", "num_encounters", "num_diagnoses"),
    category="race",
    categories=("white", "black", "hispanic", "asian", "other"),
    fallback="other",
    binary_target="has_died",
    continuous_targets=("survival_days", "healthcare_cost"),
)

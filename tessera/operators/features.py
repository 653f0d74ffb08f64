"""Feature projections and scalers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureSpec

FLOOR = 1e-12


def dataset(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """id, all features and all targets as doubles: one projection."""
    return df.select(F.col(spec.id).alias("id"), *spec.features(), *spec.targets())


@dataclass(frozen=True)
class Scaler:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, self.std, strict=True)})

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.columns, self.mean, self.std, strict=True)), "name string, mean double, std double")


def scaler_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, mean, std (population, variance floored) of each column in one pass; (0, 1) for no rows."""
    aggs = [a.alias(f"_{i}_{k}") for i, c in enumerate(columns) for k, a in enumerate((F.avg(c), F.var_pop(c)))]
    flat = df.agg(*aggs)
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("name"),
                F.coalesce(F.col(f"_{i}_0"), F.lit(0.0)).alias("mean"),
                F.when(F.col(f"_{i}_1").isNull(), 1.0).otherwise(F.sqrt(F.greatest(F.col(f"_{i}_1"), F.lit(FLOOR)))).alias("std"),
            )
            for i, c in enumerate(columns)
        )
    )
    return flat.select(F.inline(rows))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    rows = {r["name"]: r for r in scaler_rows(df, columns).collect()}
    return Scaler(tuple(columns), tuple(rows[c]["mean"] for c in columns), tuple(rows[c]["std"] for c in columns))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column over its range, 0 for a constant one; bounds are one aggregated row."""
    bounds = df.agg(*(a for c in columns for a in (F.min(c).alias(f"_{c}_low"), F.max(c).alias(f"_{c}_high"))))
    wide = df.crossJoin(F.broadcast(bounds))
    out = {}
    for c in columns:
        low, high = F.col(f"_{c}_low").cast("double"), F.col(f"_{c}_high").cast("double")
        out[c] = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)
    return wide.withColumns(out).select(*df.columns)

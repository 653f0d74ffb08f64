"""Split, scale, train three models, evaluate, score, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import dot, sigmoid
from ..operators import features as ft
from ..operators import metrics, models
from ..operators.sampling import in_test
from ..spec import FeatureSpec
from ..staging import staged

HIGH_RISK = 0.6
BUNDLE = "features array<string>, scaler_mean array<double>, scaler_std array<double>, w_risk array<double>, w_survival array<double>, w_cost array<double>, survival_mean double, survival_std double, cost_mean double, cost_std double"


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 60
    rate: float = 0.5
    l2: float = 1e-4
    test_fraction: float = 0.2
    seed: int = 42
    scaler_scope: str = "train"  # or "all", which lets test rows into the scaler


@dataclass(frozen=True)
class Bundle:
    """The trained models: a few dozen numbers."""

    features: tuple[str, ...]
    scaler_mean: tuple[float, ...]
    scaler_std: tuple[float, ...]
    w_risk: tuple[float, ...]
    w_survival: tuple[float, ...]
    w_cost: tuple[float, ...]
    survival_mean: float
    survival_std: float
    cost_mean: float
    cost_std: float
    history: dict[str, list[float]] = field(default_factory=dict, compare=False)

    def table(self, spark: SparkSession) -> DataFrame:
        row = (list(self.features), *(list(x) for x in (self.scaler_mean, self.scaler_std, self.w_risk, self.w_survival, self.w_cost)), self.survival_mean, self.survival_std, self.cost_mean, self.cost_std)
        return spark.createDataFrame([row], BUNDLE)


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    bundle.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    r = spark.read.schema(BUNDLE).parquet(path).first()
    return Bundle(*(tuple(r[c]) for c in ("features", "scaler_mean", "scaler_std", "w_risk", "w_survival", "w_cost")), *(r[c] for c in ("survival_mean", "survival_std", "cost_mean", "cost_std")))


def score(df: DataFrame, bundle: Bundle, spec: FeatureSpec) -> DataFrame:
    """``df`` with risk, survival, cost.  Weights are literals: a narrow projection, no join and no Python."""
    raw = df.withColumns({f"_x{i}": f for i, f in enumerate(spec.features())})
    xs = [(F.col(f"_x{i}") - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(bundle.scaler_mean, bundle.scaler_std, strict=True))]
    scaled = raw.withColumns({f"_x{i}": x for i, x in enumerate(xs)})
    z = [F.col(f"_x{i}") for i in range(len(xs))]
    survival = dot(bundle.w_survival, z) * bundle.survival_std + bundle.survival_mean
    cost = dot(bundle.w_cost, z) * bundle.cost_std + bundle.cost_mean
    out = scaled.withColumn("_z", dot(bundle.w_risk, z)).withColumns({"risk": sigmoid(F.col("_z")), "survival": F.greatest(survival, F.lit(0.0)), "cost": F.greatest(cost, F.lit(0.0))})
    return out.drop("_z", *(f"_x{i}" for i in range(len(xs))))


def split_dataset(df: DataFrame, spec: FeatureSpec, config: TrainConfig) -> DataFrame:
    """id, features, targets and is_test of each row."""
    return ft.dataset(df, spec).withColumn("is_test", in_test(config.seed, F.col("id"), config.test_fraction))


def scaler_rows(data: DataFrame, config: TrainConfig) -> DataFrame:
    """Rows of ``split_dataset`` that the scaler is fitted on."""
    if config.scaler_scope not in ("train", "all"):
        raise ValueError(f"unknown scaler scope: {config.scaler_scope}")
    return data if config.scaler_scope == "all" else data.filter("NOT is_test")


def fit(df: DataFrame, spec: FeatureSpec, config: TrainConfig = TrainConfig()) -> tuple[Bundle, DataFrame]:
    """The trained bundle and the standardised rows of the test part with their targets.

    The dataset is written once, so ``df`` is made once for scaling, training and all metrics.
    """
    data = staged(split_dataset(df, spec, config), "dataset")
    fitted_on = scaler_rows(data, config)
    targets = (spec.binary_target, *spec.continuous_targets)
    stats = ft.fit_scaler(fitted_on, [*spec.names, *spec.continuous_targets])
    k = len(spec.names)
    scaler = ft.Scaler(stats.columns[:k], stats.mean[:k], stats.std[:k])
    target_scaler = ft.Scaler(stats.columns[k:], stats.mean[k:], stats.std[k:])
    train_rows = target_scaler.transform(scaler.transform(data.filter("NOT is_test"))).select(*spec.names, *targets)
    jobs = {name: (model, y) for (name, model), y in zip(models.MODELS.items(), targets, strict=True)}
    fitted = models.train_all(train_rows, jobs, spec.names, config.epochs, config.rate, config.l2)
    weights = {name: tuple(float(x) for x in w) for name, (w, _) in fitted.items()}
    history = {name: losses for name, (_, losses) in fitted.items()}
    bundle = Bundle(
        tuple(spec.names), scaler.mean, scaler.std, weights["mortality"], weights["survival"], weights["cost"],
        target_scaler.mean[0], target_scaler.std[0], target_scaler.mean[1], target_scaler.std[1], history,
    )
    return bundle, scaler.transform(data.filter("is_test"))


def evaluate(test: DataFrame, bundle: Bundle, spec: FeatureSpec) -> DataFrame:
    """(model, metric, value) on a standardised test part; regressions in original units, not clamped."""
    z = [F.col(c) for c in spec.names]
    risk, survival, cost = spec.binary_target, *spec.continuous_targets
    rows = test.select(
        F.col(risk).alias("y"), F.col(survival).alias("y_survival"), F.col(cost).alias("y_cost"),
        sigmoid(dot(bundle.w_risk, z)).alias("p"),
        (dot(bundle.w_survival, z) * bundle.survival_std + bundle.survival_mean).alias("survival"),
        (dot(bundle.w_cost, z) * bundle.cost_std + bundle.cost_mean).alias("cost"),
    )
    parts = [("mortality", metrics.classification_metrics(rows, "p", "y")), ("mortality", metrics.auc(rows, "p", "y")), ("survival", metrics.regression_metrics(rows, "survival", "y_survival")), ("cost", metrics.regression_metrics(rows, "cost", "y_cost"))]
    out = None
    for model, part in parts:
        long = part.select(F.inline(F.array(*(F.struct(F.lit(model).alias("model"), F.lit(c).alias("metric"), F.col(c).alias("value")) for c in part.columns))))
        out = long if out is None else out.unionByName(long)
    return out


def loss_table(spark: SparkSession, history: dict[str, Sequence[float]]) -> DataFrame:
    """(model, epoch, loss, shown): shown marks every n/5-th epoch and the last."""
    rows = []
    for model, losses in history.items():
        step = max(1, len(losses) // 5)
        rows += [(model, e, float(x), e % step == 0 or e == len(losses) - 1) for e, x in enumerate(losses)]
    return spark.createDataFrame(rows, "model string, epoch long, loss double, shown boolean")


def risk_report(scores: DataFrame) -> DataFrame:
    """One row about scored rows: how many, mean risk, high risks, survival, cost."""
    return scores.agg(
        F.count("*").alias("n"),
        F.avg("risk").alias("mean_risk"),
        F.count_if(F.col("risk") >= HIGH_RISK).alias("high_risk"),
        F.avg("survival").alias("mean_survival_days"),
        (F.avg("survival") / 365).alias("mean_survival_years"),
        F.avg("cost").alias("mean_cost"),
        F.sum("cost").alias("total_cost"),
    )


def trained_weights(bundle: Bundle) -> np.ndarray:
    return np.array([bundle.w_risk, bundle.w_survival, bundle.w_cost])

"""Features, scalers, gradients, training, scoring and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import models
from ..plans import training
from ..staging import scratch_folder, staged
from .registry import DATA_SQL, LINES, lines, query, rounded

ALL = [*LINES.names, LINES.binary_target, *LINES.continuous_targets]
EPOCHS, RATE, L2 = 60, 0.5, 1e-4


def _data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.dataset(lines(spark, sf_dir), LINES)


@query(f"WITH {DATA_SQL} SELECT id, " + ", ".join(LINES.names[6:]) + " FROM data")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", *LINES.features()[6:])


@query(f"WITH {DATA_SQL} SELECT id, " + ", ".join(LINES.names) + " FROM data")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", *LINES.features())


@query(f"WITH {DATA_SQL} SELECT id, {', '.join(ALL)} FROM data")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir)


STD = "sqrt(greatest(var_pop({c}), 1e-12))"


#: Digits of means: those of columns of two decimals over 6,000 or 60,000 rows have no tie at the seventh.
MEAN_DIGITS = 7


def _scaler_rows_sql(columns, rows: str = "data", more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {more}'{c}' AS name, round(avg({c}), {MEAN_DIGITS}) AS mean, round({STD.format(c=c)}, 6) AS std FROM {rows}" for c in columns)


def _scaler_sql(columns) -> str:
    return f"WITH {DATA_SQL} " + _scaler_rows_sql(columns)


@query(_scaler_sql(LINES.names))
def fit_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.scaler_rows(_data(spark, sf_dir), LINES.names), mean=MEAN_DIGITS, std=6)


@query(_scaler_sql(LINES.continuous_targets))
def fit_target_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.scaler_rows(_data(spark, sf_dir), LINES.continuous_targets), mean=MEAN_DIGITS, std=6)


TRAIN_SQL = "(SELECT * FROM data WHERE NOT (('0x' || substr(md5('42|' || id), 1, 8))::BIGINT % 10000 < 2000))"


@query(f"WITH {DATA_SQL} " + " UNION ALL ".join(_scaler_rows_sql((*LINES.names, *LINES.continuous_targets), rows, f"'{scope}' AS scope, ") for scope, rows in (("train", TRAIN_SQL), ("all", "data"))))
def scaler_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaler of training, fitted on the rows that it is allowed to see: those of the training part, or all."""
    out = None
    for scope in ("train", "all"):
        config = training.TrainConfig(scaler_scope=scope)
        seen = training.scaler_rows(training.split_dataset(lines(spark, sf_dir), LINES, config), config)
        rows = ft.scaler_rows(seen, [*LINES.names, *LINES.continuous_targets]).select(F.lit(scope).alias("scope"), "*")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, mean=MEAN_DIGITS, std=6)


@query(f"WITH {DATA_SQL} SELECT id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM data)) / (SELECT {STD.format(c=c)} FROM data), 8) AS {c}" for c in LINES.names) + " FROM data")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir).select("id", *LINES.names)
    return rounded(ft.fit_scaler(data, LINES.names).transform(data), **dict.fromkeys(LINES.names, 8))


@query(f"WITH {DATA_SQL}, z AS (SELECT id, ship_days, (ship_days - (SELECT avg(ship_days) FROM data)) / (SELECT {STD.format(c='ship_days')} FROM data) AS z FROM data) SELECT id, round(z, 8) AS scaled, ship_days AS back FROM z")
def target_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target to its scale and back."""
    data = _data(spark, sf_dir).select("id", "ship_days")
    scaler = ft.fit_scaler(data, ["ship_days"])
    scaled = scaler.transform(data)
    return scaled.select("id", F.round("ship_days", 8).alias("scaled"), F.round(F.col("ship_days") * scaler.std[0] + scaler.mean[0], 4).alias("back"))


@query(f"WITH {DATA_SQL} SELECT id, " + ", ".join(f"round(({c} - (SELECT min({c}) FROM data)) / (SELECT max({c}) - min({c}) FROM data), 9) AS {c}" for c in LINES.names) + " FROM data")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.min_max(_data(spark, sf_dir).select("id", *LINES.names), LINES.names), **dict.fromkeys(LINES.names, 9))


def _z_sql(rows: str = "data", more: str = "", fit: str = "true") -> str:
    """Standardised features and continuous targets; moments are those of the rows that ``fit`` holds for."""
    z = ", ".join(f"({c} - avg({c}) FILTER ({fit}) OVER ()) / sqrt(greatest(var_pop({c}) FILTER ({fit}) OVER (), 1e-12)) AS {c}" for c in (*LINES.names, *LINES.continuous_targets))
    return f"z AS MATERIALIZED (SELECT id, {z}, returned{more} FROM {rows})"


Z_SQL = f"{DATA_SQL},\n{_z_sql()}"
#: Some weights that no symmetry hides.
START = tuple(round(0.3 * (-0.8) ** i + 0.01 * i, 4) for i in range(len(LINES.names) + 1))
WEIGHT_NUMBERS = range(len(START))
#: The SQL of each link and loss, of ``t`` (the linear part), ``p`` (what the link makes of it) and ``y``.
LOGISTIC_SQL = ("1 / (1 + exp(-({t})))", "-({y} * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)))")
LINEAR_SQL = ("({t})", "({p} - {y}) * ({p} - {y}) / 2")


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written before they are scaled, so the tables are joined once for both passes."""
    columns = [*LINES.names, *LINES.continuous_targets]
    data = staged(_data(spark, sf_dir).select(*columns, LINES.binary_target), "data")
    return ft.fit_scaler(data, columns).transform(data)


def _gradient_sql(kind: tuple[str, str], y: str) -> str:
    z = " + ".join([str(START[0]) + "::DOUBLE", *(f"{w}::DOUBLE * {c}" for w, c in zip(START[1:], LINES.names, strict=True))])
    sums = ", ".join(["round(sum(p - y), 4) AS g0", *(f"round(sum((p - y) * {c}), 4) AS g{i + 1}" for i, c in enumerate(LINES.names))])
    return f"WITH {Z_SQL}, p AS (SELECT *, {y} AS y, {z} AS t FROM z), q AS (SELECT *, {kind[0].format(t='t')} AS p FROM p) SELECT {sums}, round(sum({kind[1].format(p='p', y='y')}), 4) AS loss, count(*) AS n FROM q"


def _flat_gradient(state: DataFrame) -> DataFrame:
    return state.select(*(F.round(F.col("g")[i], 4).alias(f"g{i}") for i in WEIGHT_NUMBERS), F.round("loss", 4).alias("loss"), "n")


@query(_gradient_sql(LOGISTIC_SQL, "returned"))
def logistic_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_gradient(models.gradient_state(_standardised(spark, sf_dir), models.LOGISTIC, START, LINES.names, "returned"))


@query(_gradient_sql(LINEAR_SQL, "o_totalprice"))
def linear_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_gradient(models.gradient_state(_standardised(spark, sf_dir), models.LINEAR, START, LINES.names, "o_totalprice"))


@query(" UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({_gradient_sql(kind, y)})" for m, kind, y in (("mortality", LOGISTIC_SQL, "returned"), ("survival", LINEAR_SQL, "ship_days"), ("cost", LINEAR_SQL, "o_totalprice"))))
def block_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradients of all three models in one pass over blocks of rows."""
    targets = [LINES.binary_target, *LINES.continuous_targets]
    packed = models.blocks(_standardised(spark, sf_dir), LINES.names, targets)
    jobs = [(model, at) for at, model in enumerate(models.MODELS.values())]
    d = len(START)
    g, losses, n = models.block_gradients(packed, d, d + len(targets), jobs, np.array([START] * len(jobs)))
    rows = [(name, g[j].tolist(), float(losses[j]), n) for j, name in enumerate(models.MODELS)]
    state = spark.createDataFrame(rows, "model string, g array<double>, loss double, n long")
    return state.select("model", *(F.round(F.col("g")[i], 4).alias(f"g{i}") for i in WEIGHT_NUMBERS), F.round("loss", 4).alias("loss"), "n")


def _descent_sql(name: str, kind: tuple[str, str], y: str, rows: str = "z") -> str:
    """Gradient descent as a recursive relation (epoch, w0.., loss): each step aggregates all rows at the weights before it."""
    x = ["1.0::DOUBLE", *LINES.names]
    t = " + ".join(f"w{i} * {x[i]}" for i in WEIGHT_NUMBERS)
    p = kind[0].format(t=t)
    step = ", ".join(f"any_value(w{i}) - {RATE}::DOUBLE * (avg((p - {y}) * {x[i]}){f' + {L2}::DOUBLE * any_value(w{i})' if i else ''}) AS w{i}" for i in WEIGHT_NUMBERS)
    zeros = ", ".join(f"0.0::DOUBLE AS w{i}" for i in WEIGHT_NUMBERS)
    return f"""{name} AS (
  SELECT 0 AS epoch, {zeros}, 0.0::DOUBLE AS loss
  UNION ALL
  SELECT any_value(epoch) + 1 AS epoch, {step}, avg({kind[1].format(p='p', y=y)}) AS loss
  FROM (SELECT *, {p} AS p FROM {name}, {rows} WHERE epoch < {EPOCHS}) HAVING count(*) > 0)"""


def _train_sql(kind: tuple[str, str], y: str) -> str:
    found = ", ".join(f"w{i}" for i in WEIGHT_NUMBERS)
    return f"WITH RECURSIVE {Z_SQL},\n{_descent_sql('gd', kind, y)}\nSELECT i AS weight, round([{found}][i + 1], 8) + 0.0::DOUBLE AS value FROM gd, range({len(START)}) r(i) WHERE epoch = {EPOCHS}"


def _weights(spark: SparkSession, weights) -> DataFrame:
    return spark.createDataFrame([(i, round(float(w), 8) + 0.0) for i, w in enumerate(weights)], "weight long, value double")


@query(_train_sql(LOGISTIC_SQL, "returned"))
def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, models.train(_standardised(spark, sf_dir), models.LOGISTIC, LINES.names, "returned", EPOCHS, RATE, L2)[0])


@query(_train_sql(LINEAR_SQL, "o_totalprice"))
def train_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, models.train(_standardised(spark, sf_dir), models.LINEAR, LINES.names, "o_totalprice", EPOCHS, RATE, L2)[0])


#: Fixed weights, so that scoring is compared apart from training.
WEIGHTS = tuple(0.05 * ((-1) ** i) * (i + 1) for i in range(len(LINES.names) + 1))
MEANS = tuple(10.0 * (i + 1) for i in range(len(LINES.names)))
STDS = tuple(5.0 + i for i in range(len(LINES.names)))
FIXED = training.Bundle(tuple(LINES.names), MEANS, STDS, WEIGHTS, tuple(-w for w in WEIGHTS), tuple(2 * w for w in WEIGHTS), 700.0, 50.0, 20000.0, 3000.0)


def _linear(weights) -> str:
    terms = [f"{w!r}::DOUBLE * ({c} - {m!r}::DOUBLE) / {s!r}::DOUBLE" for w, c, m, s in zip(weights[1:], LINES.names, MEANS, STDS, strict=True)]
    return " + ".join([f"{weights[0]!r}::DOUBLE", *(f"({t})" for t in terms)])


SCORED_SQL = f"""{DATA_SQL}, zs AS (SELECT id, {_linear(FIXED.w_risk)} AS zr, {_linear(FIXED.w_survival)} AS zv, {_linear(FIXED.w_cost)} AS zc FROM data),
scored AS (SELECT id, CASE WHEN zr >= 0 THEN 1 / (1 + exp(-zr)) ELSE exp(zr) / (1 + exp(zr)) END AS risk, greatest(zv * 50 + 700, 0) AS survival, greatest(zc * 3000 + 20000, 0) AS cost FROM zs)"""


@query(f"WITH {SCORED_SQL} SELECT id, round(risk, 8) AS risk, round(survival, 4) AS survival, round(cost, 4) AS cost FROM scored")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = training.score(lines(spark, sf_dir), FIXED, LINES)
    return rounded(scored.select("id", "risk", "survival", "cost"), risk=8, survival=4, cost=4)


@query(f"WITH {SCORED_SQL} SELECT id, round(risk, 8) AS risk, round(survival, 4) AS survival, round(cost, 4) AS cost FROM scored")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model that was saved and read again."""
    path = scratch_folder(spark, "model")
    training.save_bundle(FIXED, spark, path)
    scored = training.score(lines(spark, sf_dir), training.load_bundle(spark, path), LINES)
    return rounded(scored.select("id", "risk", "survival", "cost"), risk=8, survival=4, cost=4)


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n, round(avg(risk), 8) AS mean_risk, count(*) FILTER (risk >= 0.6) AS high_risk, round(avg(survival), 4) AS mean_survival_days, round(avg(survival) / 365, 6) AS mean_survival_years, round(avg(cost), 2) AS mean_cost, round(sum(cost), 0) AS total_cost FROM scored")
def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = training.risk_report(training.score(lines(spark, sf_dir), FIXED, LINES))
    return rounded(report, mean_risk=8, mean_survival_days=4, mean_survival_years=6, mean_cost=2, total_cost=0)


CONFIG = training.TrainConfig(epochs=EPOCHS, rate=RATE, l2=L2)


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[training.Bundle, DataFrame]:
    return training.fit(lines(spark, sf_dir), LINES, CONFIG)


PARTS = {"mortality": (LOGISTIC_SQL, "returned"), "survival": (LINEAR_SQL, "ship_days"), "cost": (LINEAR_SQL, "o_totalprice")}


def _fit_sql() -> str:
    """The whole training: split, scalers of the training part, and the descent of each model."""
    split = "split AS (SELECT *, ('0x' || substr(md5('42|' || id), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM data)"
    targets = ", ".join(f"{y} AS y_{m}, avg({y}) FILTER (NOT is_test) OVER () AS m_{m}, sqrt(greatest(var_pop({y}) FILTER (NOT is_test) OVER (), 1e-12)) AS s_{m}" for m, (_, y) in PARTS.items())
    parts = [DATA_SQL, split, _z_sql("split", f", is_test, {targets}", "NOT is_test"), "train AS MATERIALIZED (SELECT * FROM z WHERE NOT is_test)"]
    return "WITH RECURSIVE " + ",\n".join([*parts, *(_descent_sql(f"gd_{m}", kind, y, "train") for m, (kind, y) in PARTS.items())])


@query(_fit_sql() + "\n" + " UNION ALL ".join(f"SELECT '{m}' AS model, epoch - 1 AS epoch, round(loss, 8) AS loss FROM gd_{m} WHERE epoch > 0" for m in PARTS))
def loss_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of each model before each step."""
    bundle, _ = _fitted(spark, sf_dir)
    return training.loss_table(spark, bundle.history).select("model", F.col("epoch").cast("int").alias("epoch"), F.round("loss", 8).alias("loss"))


def _report_sql() -> str:
    """Metrics of the test part at the last weights; regressions in their own units."""
    out, made = [], []
    for m, (kind, _) in PARTS.items():
        t = " + ".join(["w0", *(f"w{i + 1} * {c}" for i, c in enumerate(LINES.names))])
        p = kind[0].format(t=t) if m == "mortality" else f"({t}) * s_{m} + m_{m}"
        made.append(f"p_{m} AS (SELECT {p} AS p, y_{m} AS y FROM z, gd_{m} WHERE is_test AND epoch = {EPOCHS})")
        if m == "mortality":
            loss = kind[1].format(p="p", y="y")
            made.append("ranks AS (SELECT y, n, before + (n + 1) / 2.0::DOUBLE AS rank FROM (SELECT p, sum(y) AS y, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p_mortality GROUP BY p))")
            out += [f"SELECT '{m}' AS model, 'accuracy' AS metric, avg(((p >= 0.5) = (y = 1))::INT) AS value FROM p_{m}", f"SELECT '{m}', 'log_loss', avg({loss}) FROM p_{m}"]
            out.append("SELECT 'mortality', 'auc', (sum(y * rank) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (sum(n) - sum(y))) FROM ranks")
        else:
            forms = {"rmse": "sqrt(avg((p - y) * (p - y)))", "mae": "avg(abs(p - y))", "r2": "1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y))"}
            out += [f"SELECT '{m}', '{name}', {form} FROM p_{m}" for name, form in forms.items()]
    return _fit_sql() + ",\n" + ",\n".join(made) + "\nSELECT model, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(out) + ")"


@query(_report_sql())
def train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, scale, train, evaluate: (model, metric, value)."""
    bundle, test = _fitted(spark, sf_dir)
    return rounded(training.evaluate(test, bundle, LINES), value=6)

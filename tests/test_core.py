"""Operators of the cohort engine on hand-made rows: bounds, empties, ties, degenerate inputs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as fc
from tessera.operators import aggregates as ag
from tessera.operators import features as ft
from tessera.operators import joins, metrics, models, quality, sampling
from tessera.plans import cohort, training
from tessera.session import scratch_path
from tessera.sources import files, synthetic
from tessera.spec import COHORT
from tessera.streaming import jobs

RAW = ["id", "age", "race", "ethnicity", "marital", "income", "coverage", "healthcare_cost", "psa", "num_encounters", "num_diagnoses", "has_died", "survival_days"]


def raw(spark, *rows):
    """Rows given by some columns; the others are empty."""
    return spark.createDataFrame([tuple(r.get(c, "") for c in RAW) for r in rows], ", ".join(f"{c} string" for c in RAW))


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"id": "", "age": "1", "psa": "1"}, "id"),
        ({"id": " \t", "age": "1", "psa": "1"}, "id"),
        *(({"id": "a", "age": age, "psa": "1"}, "age") for age in ("-1", "121", "12.5", "", "x", None)),
        *(({"id": "a", "age": "1", "psa": psa}, "psa") for psa in ("-0.1", "200.1", "", "1.5d", "null", None, "inf")),
        *(({"id": "a", "age": age, "psa": psa}, "valid") for age, psa in (("0", "0"), ("120", "200"), ("+5", "1e1"), (" 7\t", " .5 "), ("1", "NaN"))),
    ],
)
def test_reject_rules(spark, row, reason):
    assert quality.reject_counts(raw(spark, row)).collect() == [(reason, 1)]


def test_typed_rows_defaults(spark):
    rows = quality.typed_rows(raw(spark, {"id": " a ", "age": "3", "psa": "4", "race": " WHITE\t", "income": "x", "num_encounters": "2.0", "has_died": "TRUE", "survival_days": "99999999999"})).collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["id"], r["race"], r["income"], r["num_encounters"], r["has_died"], r["survival_days"]) == ("a", "white", 0.0, 0, True, 99999999999)


def test_request_rules(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (121, -1.0, -1.0, 1.1), (None, 1.0, 1.0, 1.0)], "age long, income double, psa double, coverage double")
    assert [sorted(r[0]) for r in df.select(quality.violations(quality.request_rules())).collect()] == [[], ["age", "coverage", "income", "psa"], ["age"]]
    strict = df.limit(1).select(quality.violations(quality.request_rules(strict_required=True))).first()[0]
    assert sorted(strict) == ["age", "income", "psa"]


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(' ID ,PSA,Age,other\na,1,2,x\n"b""q",3,4,y\nshort,1\nlong,1,2,3,4\n\n"c,d",5,6,z\n')
    rows = files.csv_scan(spark, str(path), ["id", "age", "psa", "income"])
    assert sorted(map(tuple, rows.collect())) == [("a", "2", "1", ""), ('b"q', "4", "3", ""), ("c,d", "6", "5", "")]
    assert rows.select("id").count() == 3 == rows.count()


def test_missing_columns_and_files(spark, tmp_path):
    df = spark.range(1)
    assert files.require_columns(df, ["id"]) is df
    with pytest.raises(files.MissingColumns, match="age"):
        files.require_columns(df, ["id", "age"])
    with pytest.raises(FileNotFoundError, match="patients"):
        files.read_raw(spark, str(tmp_path), "patients", "Id string")
    (tmp_path / "claims.csv").write_text("PATIENTID,DIAGNOSIS1\na,x\n")
    assert files.read_raw(spark, str(tmp_path), "claims", "PATIENTID string, DIAGNOSIS1 string").collect() == [("a", "x")]
    assert cohort.diagnosis_source(spark, str(tmp_path)).endswith("claims.csv")
    assert cohort.diagnosis_counts(None, None, spark).count() == 0


def test_profile_of_none_one_and_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = {r["col"]: r for r in ag.column_profile(df, ["a", "b"]).collect()}
    assert (got["a"]["n"], got["a"]["nulls"], got["a"]["null_pct"], got["a"]["mean"], got["a"]["variance"], got["a"]["std"]) == (1, 1, 50.0, 1.0, 0.0, 0.0)
    assert got["b"]["n"] == 0 and got["b"]["mean"] is None and got["b"]["variance"] is None
    empty = {r["col"]: r for r in ag.column_profile(df.limit(0), ["a"]).collect()}
    assert empty["a"]["n"] == 0 and empty["a"]["null_pct"] == 0.0


def test_profile_states_merge_to_the_whole(spark):
    df = spark.range(1000).select((F.col("id") % 97 * 1.5).alias("x"))
    whole = ag.column_profile(df, ["x"]).first()
    parts = [ag.profile_state(df.filter(F.col("x") < 10), ["x"]), ag.profile_state(df.filter(F.col("x") >= 10), ["x"]), ag.profile_state(df.limit(0), ["x"])]
    merged = ag.finish_profile(ag.merge_states(parts[0].union(parts[1]).union(parts[2]))).first()
    for c in ("n", "nulls", "min", "max"):
        assert merged[c] == whole[c]
    for c in ("mean", "variance", "std"):
        assert merged[c] == pytest.approx(whole[c])


def scores(spark, *pairs):
    return spark.createDataFrame([(float(s), float(y)) for s, y in pairs], "s double, y double")


@pytest.mark.parametrize("pairs, value", [([(0.1, 0), (0.9, 1)], 1.0), ([(0.9, 0), (0.1, 1)], 0.0), ([(0.5, 0), (0.5, 1), (0.5, 1)], 0.5), ([(0.3, 1), (0.4, 1)], 0.5), ([], 0.5)])
def test_auc_cases(spark, pairs, value):
    assert metrics.auc(scores(spark, *pairs), "s", "y").first()[0] == value


def test_auc_equals_pair_counts(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300) / 10, rng.random() < 0.3) for _ in range(2000)]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(scores(spark, *pairs), "s", "y").first()[0] == pytest.approx(expected, abs=1e-12)


def test_regression_and_classification_of_nothing(spark):
    assert tuple(metrics.regression_metrics(scores(spark), "s", "y").first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.classification_metrics(scores(spark), "s", "y").first()) == (0.0, 0.0)
    assert metrics.regression_metrics(scores(spark, (1, 2), (3, 2)), "s", "y").first()["r2"] == 0.0


def test_scaler(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(x) for x in rng.normal([0, 10, 20, 30], [1, 2, 3, 4])) + (7.0,) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k double")
    out = ft.fit_scaler(df, ["a", "b", "c", "d", "k"]).transform(df)
    for c in "abcd":
        mean, std = out.agg(F.avg(c), F.stddev_pop(c)).first()
        assert abs(mean) < 1e-6 and abs(std - 1) < 1e-6
    assert out.agg(F.max("k")).first()[0] == 0.0
    assert [tuple(r) for r in ft.scaler_rows(df.limit(0), ["a"]).collect()] == [("a", 0.0, 1.0)]
    assert ft.min_max(df, ["k"]).agg(F.max("k")).first()[0] == 0.0


@pytest.mark.parametrize("model, y", [(models.LOGISTIC, "y"), (models.LINEAR, "z")])
def test_gradient_does_not_depend_on_partitions(spark, model, y):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), float(rng.random() < 0.5), float(rng.normal())) for a, b in rng.normal(size=(5000, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double, z double")
    w = np.array([0.2, -0.4, 0.9])
    state = models.gradient_state(df, model, w.tolist(), ["a", "b"], y).first()
    for n in (1, 3, 7, 64):
        g, loss, count = models.gradient(df.repartition(n), model, w, ["a", "b"], y)
        assert count == 5000 == state["n"]
        assert g == pytest.approx(np.array(state["g"]), rel=1e-9) and loss == pytest.approx(state["loss"], rel=1e-9)


def test_logistic_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2 * x[:, 1] + 0.5)))
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double").repartition(2).persist()
    w, losses = models.train(df, models.LOGISTIC, ["a", "b"], "y", 30, 1.0, 1e-4)
    assert losses[0] == pytest.approx(math.log(2)) and losses == sorted(losses, reverse=True)
    scored = df.select(fc.sigmoid(fc.dot([float(v) for v in w], [F.col("a"), F.col("b")])).alias("s"), "y")
    assert metrics.auc(scored, "s", "y").first()[0] >= 0.8
    df.unpersist()


def test_linear_learns_and_equals_plain_descent(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    y = 3 * x[:, 0] - 1.5 * x[:, 1] + 0.7 + 0.05 * rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    w, losses = models.train(df, models.LINEAR, ["a", "b"], "y", 100, 0.5, 1e-4)
    scored = df.select(fc.dot([float(v) for v in w], [F.col("a"), F.col("b")]).alias("s"), "y")
    assert metrics.regression_metrics(scored, "s", "y").first()["r2"] >= 0.98
    plain, a = np.zeros(3), np.column_stack([np.ones(3000), x])
    for _ in range(100):
        g = a.T @ (a @ plain - y) / 3000
        g[1:] += 1e-4 * plain[1:]
        plain = plain - 0.5 * g
    assert w == pytest.approx(plain, rel=1e-9) and losses[-1] < losses[0]


def test_training_end_to_end_on_a_synthetic_cohort(spark, tmp_path):
    patients = synthetic.synthetic(spark, 4000).persist()
    bundle, test = training.fit(patients, COHORT, training.TrainConfig(epochs=15, rate=0.5))
    report = {(r["model"], r["metric"]): r["value"] for r in training.evaluate(test, bundle, COHORT).collect()}
    assert report["mortality", "auc"] > 0.7 and report["survival", "r2"] > 0.7 and report["cost", "r2"] > 0.7
    training.save_bundle(bundle, spark, str(tmp_path / "m"))
    again = training.load_bundle(spark, str(tmp_path / "m"))
    assert again == bundle
    one = training.score(patients, bundle, COHORT).select("id", "risk", "survival", "cost")
    assert sorted(one.collect()) == sorted(training.score(patients, again, COHORT).select("id", "risk", "survival", "cost").collect())
    assert one.agg(F.min("survival"), F.min("cost")).first()[0] >= 0
    loss = training.loss_table(spark, bundle.history)
    assert loss.count() == 45 and loss.filter("model = 'cost' AND shown").count() >= 5
    patients.unpersist()


def test_unknown_category_and_model(spark):
    df = spark.createDataFrame([("black",), ("martian",), (None,), ("BLACK",)], "race string")
    hot = df.select(*fc.one_hot(F.col("race"), COHORT.categories, COHORT.fallback)).collect()
    assert [tuple(r) for r in hot] == [(0, 1, 0, 0, 0), (0, 0, 0, 0, 1), (0, 0, 0, 0, 1), (0, 0, 0, 0, 1)]
    assert models.model_named("survival") is models.LINEAR
    with pytest.raises(KeyError):
        models.model_named("other")


def test_splits(spark):
    df = spark.range(10)
    assert sampling.split_exact(df, "id", 0.25, 42).filter("is_test").count() == 2
    assert sampling.split_exact(df, "id", 0.0, 42).filter("is_test").count() == 0
    assert sampling.split_exact(df, "id", 1.0, 42).filter("is_test").count() == 10
    a = {r["id"] for r in spark.range(5000).filter(sampling.in_test(42, F.col("id"), 0.2)).collect()}
    b = {r["id"] for r in spark.range(5000).repartition(7).filter(sampling.in_test(42, F.col("id"), 0.2)).collect()}
    assert a == b and 900 < len(a) < 1100


@pytest.mark.parametrize("n", [5, 25, 100])
def test_resize(spark, n):
    df = spark.range(25).select("id", (F.col("id") * 2).alias("v"))
    out = sampling.resize(df, "id", n)
    assert out.count() == n and out.columns == df.columns
    assert out.distinct().count() == min(n, 25) or n > 25
    with pytest.raises(ValueError):
        sampling.resize(df.limit(0), "id", n)


def test_scaled_ids(spark):
    df = spark.range(25).select("id", F.lit("old").alias("Name"))
    made = sampling.scaled(df, sampling.ScaleJob("t", "id", "NAME", "PAT"), 40)
    assert {r["Name"] for r in made.collect()} == {f"PAT-{i:09d}" for i in range(1, 41)}


def test_memo_key_holds_every_feature(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.6), (3, "a", 0.5), (4, None, 0.5)], "id long, f string, coverage double")
    calls = []

    def score(rows):
        calls.append(rows.count())
        return rows.withColumn("score", F.col("coverage") * 10)

    out, known = joins.memoised_scores(df, ["f", "coverage"], spark.createDataFrame([], "key string, score double"), score)
    assert {r["id"]: r["score"] for r in out.collect()} == {1: 5.0, 2: 6.0, 3: 5.0, 4: 5.0}
    assert calls == [3] and known.count() == 3
    again, _ = joins.memoised_scores(df, ["f", "coverage"], known, score)
    assert calls == [3, 0] and all(r["hit"] for r in again.collect())


def test_age_and_survival(spark):
    df = spark.createDataFrame([("1950-06-01", None), ("1950-06-01", "1949-01-01"), (None, None), ("1800-01-01", None)], "b string, d string").select(F.col("b").cast("date").alias("b"), F.col("d").cast("date").alias("d"))
    as_of = F.lit("2000-06-01").cast("date")
    got = [tuple(r) for r in df.select(cohort.age_years(F.col("b"), as_of), cohort.survival_days(F.col("b"), F.col("d"), as_of)).collect()]
    assert got[0] == (50, 18263) and got[1] == (50, 0) and got[2] == (68, 0) and got[3][0] == 120


def test_constant_and_empty_report(spark):
    rows = spark.createDataFrame([], "risk double, survival double, cost double")
    assert training.risk_report(rows).first()["n"] == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_files_of_one_scan_bind_by_their_own_header(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for folder, second in ((one, ' ID ,"Age, years"\n2,60\n'), (two, '"Age, years", ID \n60,2\n')):
        folder.mkdir()
        (folder / "a.csv").write_text(' ID ,"Age, years"\n1,50\n')
        (folder / "b.csv").write_text(second)
    for folder in (one, two):
        rows = files.csv_scan(spark, str(folder), ["id", "age, years"]).collect()
        assert sorted((r[0], r[1]) for r in rows) == [("1", "50"), ("2", "60")]


def test_dense_index_has_one_order_for_any_number_of_groups(spark, monkeypatch):
    df = spark.range(3000).repartition(7)
    few = {r["id"]: r["index"] for r in sampling.dense_index(df, "id").collect()}
    monkeypatch.setattr(sampling, "GROUP_ROWS", 1)
    many = {r["id"]: r["index"] for r in sampling.dense_index(df, "id", rows=3000).collect()}
    assert few == many and sorted(many.values()) == list(range(3000))


def test_scaled_ids_do_not_depend_on_partitioning(spark):
    job = sampling.ScaleJob("t", "id", "name", "PAT")
    made = []
    for parts in (2, 9):
        df = spark.range(10).select("id", F.lit("x").alias("name")).repartition(parts)
        made.append(sorted((r["id"], r["name"]) for r in sampling.scaled(df, job, 40).collect()))
    assert made[0] == made[1] and len({name for _, name in made[0]}) == 40


def test_scaler_does_not_depend_on_partitioning(spark):
    found = []
    for parts in (1, 13):
        df = spark.range(5000).select((F.col("id") % 11 / 100.0).alias("a"), (F.col("id") % 7).cast("double").alias("b")).repartition(parts)
        found.append([(r["name"], round(r["mean"], 7), round(r["std"], 6)) for r in ft.scaler_rows(df, ["a", "b"]).collect()])
    assert found[0] == found[1]


def test_telemetry_is_kept_up_to_date(spark, tmp_path):
    spark.createDataFrame([(1.0,), (3.0,)], "latency double").write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, "latency double", str(tmp_path / "in"))
    query = jobs.report_telemetry(stream, "latency", "telemetry_now", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("telemetry_now").collect()] == [(2, 2.0)]
        assert jobs.TELEMETRY_EVERY == "1.5 seconds"
    finally:
        query.stop()

"""Every registered query equals its DuckDB SQL; plans are what they should be."""

from __future__ import annotations

import math
import os
import time

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera import catalog  # noqa: E402
from tessera.registered.registry import lines  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    expected = sorted(tuple(same(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(same(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_is_used(spark):
    plan = lines(spark, SF).select("id", "p_size")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[-1] and "PushedFilters" in plan


def test_scoring_is_a_narrow_projection(spark):
    from tessera.plans import training
    from tessera.registered.learning import FIXED
    from tessera.registered.registry import LINES

    scored = training.score(lines(spark, SF), FIXED, LINES).select("risk")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_watermarked_window_statistics(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import jobs

    rows = spark.range(40).select((F.col("id") * 60).cast("timestamp").alias("at"), *(F.col("id").cast("double").alias(c) for c in ("risk", "survival", "cost")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, rows.schema, str(tmp_path / "in"))
    out = jobs.memory_result(jobs.running_statistics(stream, "1 minute", "at", "10 minutes"), "windows", "complete", str(tmp_path / "state"))
    assert sorted(r["n"] for r in out.collect()) == [10, 10, 10, 10]


def test_batches_run_again_replace_themselves(spark, tmp_path):
    from tessera.streaming import jobs

    for i in range(3):
        spark.range(10).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.range(1).schema
    for state in ("a", "b"):  # a second run without the first one's progress writes the same batches again
        jobs.run_available(jobs.append_batches(jobs.file_stream(spark, schema, str(tmp_path / "in"), 100), lambda df: df, str(tmp_path / "out"), str(tmp_path / state)))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_results_are_reused_within_their_time_to_live(spark, tmp_path):
    from tessera.streaming import jobs

    for i in range(3):
        spark.range(12).selectExpr("concat('k', id % 4) AS key").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        stream = jobs.file_stream(spark, "key string", str(tmp_path / "in"))
        writer = jobs.reuse_with_ttl(stream, "key", 600_000).writeStream.format("memory").queryName("reuse").outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query = writer.start()
        deadline = time.time() + 60
        while time.time() < deadline and sum(p["numInputRows"] for p in query.recentProgress) < 36:
            time.sleep(0.5)
        query.stop()
        out = spark.table("reuse")
        rows = out.groupBy("key").agg({"requests": "sum", "computed": "sum"}).collect()
        assert sorted((r["key"], r["sum(requests)"], r["sum(computed)"]) for r in rows) == [(f"k{i}", 9, 1) for i in range(4)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

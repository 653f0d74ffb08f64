"""Registered queries at sizes beyond the smallest tables: equal to their SQL, with work that grows with the rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import sampling

duckdb = pytest.importorskip("duckdb")


def equals_sql(spark, folder, name, **tables):
    """Whether a query over ``tables``, written to ``folder``, has the rows of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    return Counter(map(tuple, df.collect())) == Counter(map(tuple, found))


def test_bootstrap_of_more_rows_than_a_leaf_equals_its_sql(spark, tmp_path):
    parts = spark.range(1, 25_001).select(F.col("id").alias("p_partkey"))
    assert equals_sql(spark, tmp_path, "bootstrap_counts", part=parts)


def test_counts_by_tree_are_those_of_draws(spark):
    n, target = 3000, 60_000
    keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    found = {r["k"]: r["_times"] for r in sampling.counts_by_tree(keys, "k", target, 7, leaf_rows=20).collect()}
    assert sum(found.values()) == target and all(v > 0 for v in found.values())
    assert {r["k"]: r["_times"] for r in sampling.counts_by_tree(keys.repartition(7), "k", target, 7, leaf_rows=20).collect()} == found
    mean = target / n
    square = sum((found.get(f"k{i}", 0) - mean) ** 2 for i in range(n)) / mean
    assert abs(square - (n - 1)) < 5 * np.sqrt(2 * (n - 1))


def customers(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name"))


@pytest.mark.parametrize("n", [1500, 3999, 4000, 4001, 9000])
def test_resizing_equals_its_sql_from_fewer_and_from_more_rows(spark, tmp_path, n):
    assert equals_sql(spark, tmp_path, "resize_up", customer=customers(spark, n))


@pytest.mark.parametrize("n", [1500, 4001])
def test_scaled_rows_equal_their_sql_from_fewer_and_from_more_rows(spark, tmp_path, n):
    assert equals_sql(spark, tmp_path, "scale_rows", customer=customers(spark, n))


def test_files_of_a_stream_grow_in_number_not_in_size(spark, monkeypatch):
    from tessera.registered import streams
    from tessera.streaming import jobs

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    batches = []
    stream = streams._stream(spark, spark.range(3000), "many", 3000)
    jobs.run_available(stream.writeStream.foreachBatch(lambda df, _: batches.append((df.select(F.input_file_name()).distinct().count(), df.count()))))
    assert [files for files, _ in batches] == [10, 10, 10] and sum(n for _, n in batches) == 3000
    assert max(n for _, n in batches) < 1300


def ranges_of(spark, monkeypatch, name, folder, rows):
    """Numbers of ranges that a query deals a table of ``rows`` events into."""
    from tessera.operators import ranks
    from tessera.registered import stats

    parts, find = [], ranks.parts_for
    monkeypatch.setattr(ranks, "parts_for", lambda n, part_rows: parts.append(find(n, part_rows)) or parts[-1])
    events = spark.range(rows).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"), (F.col("id") * 7919 % 10007 / 7).alias("value"))
    assert equals_sql(spark, folder, name, events=events)
    assert [stats.part_rows(n) for n in (10, 100_000, 36_000_000)] == [500, 5_000, 1_000_000]
    return parts


@pytest.mark.parametrize("name", ["avg_rank_distinct", "auc_distinct", "score_order"])
def test_ranges_do_not_become_many(spark, monkeypatch, tmp_path, name):
    assert ranges_of(spark, monkeypatch, name, tmp_path, 30_000) == [20]


def test_state_of_reuse_is_kept_by_buckets_of_keys(spark, tmp_path):
    from tessera.streaming import jobs

    made = [(None if i % 7 == 0 else f"k{i % 7}", i * 37 % 101, i) for i in range(300)]
    df = spark.createDataFrame(made, "key string, s long, id long").select("key", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("at"), "id")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        hits = jobs.reuse_on_clock(jobs.file_stream(spark, df.schema, str(tmp_path / "in")), "key", "at", "id", 20_000, buckets=2)
        jobs.run_available(hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    written, expected = {}, {}
    for key, s, id in sorted(made, key=lambda r: (r[1], r[2])):
        expected[id] = key in written and s < written[key] + 20
        if not expected[id]:
            written[key] = s
    assert {r["id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == expected


def test_blocks_keep_columns_of_few_values_as_bytes(spark):
    from tessera.operators import models

    n = 5000
    rng = np.random.default_rng(1)
    columns = np.array([rng.integers(0, 2, n), rng.random(n), np.where(np.arange(n) == 7, np.nan, rng.integers(0, 256, n) / 3), np.minimum(np.arange(n) % 2000, 300)], float)
    cells = models._packed(columns)
    assert len(cells) < 8 * 4 + 8 * (2 + 257) + 2 * n * 8 + 2 * n * 8
    found = models._unpacked(cells, n, 5)
    assert np.array_equal(found[:, 1:], columns.T, equal_nan=True) and (found[:, 0] == 1).all()
    few = spark.range(n).select(*((F.col("id") % m).cast("double").alias(f"x{m}") for m in (2, 3, 5, 200)))
    assert models.blocks(few, few.columns[:3], few.columns[3:]).select(F.sum(F.length("cells"))).first()[0] < 5 * n + 8 * 1000 < 8 * 5 * n


def test_the_tables_are_joined_once_for_scaling_and_training(spark):
    from tessera.registered import learning

    plan = learning._standardised(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    _, test = learning._fitted(spark, "/root/testdata/sf0.001")
    assert "Join" not in test._jdf.queryExecution().executedPlan().toString()

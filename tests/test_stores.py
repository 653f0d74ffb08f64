"""What outlives a job: keyed tables, stored scores, logs; and what is counted or placed along the way."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import aggregates as ag
from tessera.operators import joins, metrics, quality, ranks, sampling
from tessera.sources import files
from tessera.sources.keyed import KeyedTable
from tessera.streaming import jobs

SCHEMA = T.StructType().add("key", "string").add("value", "long")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_keyed_table_batches_replace_themselves_and_outlive_the_catalog(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, "key", 4)
    assert table.read().count() == 0
    table.put("a", rows(spark, ("x", 1), ("y", 2)))
    table.put("b", rows(spark, ("z", 3)))
    table.put("a", rows(spark, ("x", 5)))
    assert sorted((r["key"], r["value"], r["batch"]) for r in table.read().collect()) == [("x", 5, "a"), ("z", 3, "b")]
    spark.sql(f"DROP TABLE {table.name}")  # what another session's catalog knows: nothing
    again = KeyedTable(spark.newSession(), path)
    assert (again.key, again.buckets, again.batches()) == ("key", 4, ["a", "b"])
    assert [r["key"] for r in again.read(without="a").collect()] == ["z"]
    again.forget("b")
    assert [tuple(r) for r in again.read_batch("a").collect()] == [("x", 5, "a")] and again.batches() == ["a"]
    with pytest.raises(ValueError):
        KeyedTable(spark, path, SCHEMA, "value")
    with pytest.raises(ValueError):
        again.put("no/name", rows(spark))
    again.drop()
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, path)


def test_keyed_table_learns_of_others_batches_and_takes_any_path(spark, tmp_path):
    path = str(tmp_path / "it's a table")
    mine = KeyedTable(spark, path + "/", SCHEMA, "key", 2)
    mine.put("a", rows(spark, ("x", 1)))
    # as another application leaves it
    (tmp_path / "it's a table" / "batch=b").mkdir()
    source = next((tmp_path / "it's a table" / "batch=a").glob("part-*.parquet"))
    (tmp_path / "it's a table" / "batch=b" / source.name).write_bytes(source.read_bytes())
    assert mine.batches() == ["a"]
    mine.refresh()
    assert mine.batches() == ["a", "b"] and mine.read().count() == 2
    assert KeyedTable(spark, path).name == mine.name
    mine.drop()


def test_keyed_table_is_not_shuffled(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "key", 4)
    table.put("a", rows(spark, *((f"k{i}", i) for i in range(50))))
    plan = table.read().groupBy("key").agg(F.max("value"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    table.drop()


def scored(df):
    return df.withColumn("score", F.col("x") * 2.0)


def test_scores_are_reused_until_they_expire(spark, tmp_path):
    store = joins.ScoreStore(spark, str(tmp_path / "s"), ttl=10, buckets=2)
    calls = []

    def score(df):
        calls.append(df.count())
        return scored(df)

    def ask(batch, now, *xs):
        found = store.score(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"], score, batch, now)
        return sorted((r["x"], r["score"], r["hit"]) for r in found.collect())

    assert ask("a", 0, 1.0, 1.0, 2.0) == [(1.0, 2.0, False), (1.0, 2.0, False), (2.0, 4.0, False)]
    assert ask("b", 9, 1.0, 3.0) == [(1.0, 2.0, True), (3.0, 6.0, False)]
    assert ask("b", 9, 1.0, 3.0) == [(1.0, 2.0, True), (3.0, 6.0, False)]  # run again
    assert ask("c", 10, 1.0, 3.0) == [(1.0, 2.0, False), (3.0, 6.0, True)]  # good for ten seconds, not on the tenth
    assert calls == [2, 1, 1, 1]
    assert store.table.read().count() == 4
    assert store.expire(12) == ["a"] and store.table.batches() == ["b", "c"]
    assert ask("d", 12, 1.0) == [(1.0, 2.0, True)]
    store.table.drop()


def test_prediction_log_holds_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    scores = spark.range(5).select(F.col("id").cast("string").alias("id"), *(F.lit(0.5).alias(c) for c in ("risk", "survival", "cost")))
    for batch in ("a", "b", "a"):
        files.append_predictions(scores, ["id"], path, batch)
    assert sorted(Counter(r["batch"] for r in spark.read.parquet(path).collect()).items()) == [("a", 5), ("b", 5)]


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id, AGE ,psa\n1,2,3\n"q""1",4,5\n')
    (tmp_path / "in" / "b.csv").write_text("\n\nPsa,Id,more\n6,7,8\nid,psa,age\n")
    (tmp_path / "in" / "c.csv").write_text("")
    (tmp_path / "in" / "d.csv").write_text("id,id\n8,9\n")
    found = files.csv_scan(spark, str(tmp_path / "in"), ["id", "age", "psa"])
    assert sorted(map(tuple, found.collect())) == [("1", "2", "3"), ("7", "", "6"), ("9", "", ""), ("psa", "", "id"), ('q"1', "4", "5")]
    assert found.count() == 5
    assert len(files.csv_headers(spark, str(tmp_path / "in"))) == 3


@pytest.mark.parametrize(
    "line, right",
    [("a,b", True), ('"a",b', True), ('"a""b",c', True), ('"""a""",c', True), ('"",""', True), ('"a,b",""', True), ('a"b,c', False), ('a""b,c', False), ('"a"b,c', False), ('"a,b', False), ('a,b"', False), (' "a",b', False), ('"""x",y', True)],
)
def test_quotes_stand_where_they_may(spark, line, right):
    assert spark.createDataFrame([(line,)], "l string").select(files.quoted_rightly(F.col("l"))).first()[0] is right


def test_malformed_lines_are_marked_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n1\n1,2,3\n1,a"b\n"1,2\n')
    bad = [r[files.CORRUPT] for r in files.csv_rows(spark, str(tmp_path / "a.csv")).collect()]
    assert sorted(b or "" for b in bad) == sorted(["", "1", "1,2,3", '1,a"b', '"1,2'])


def test_no_files_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert files.csv_scan(spark, str(tmp_path / "a.csv"), ["id"]).collect() == []


def test_rejects_are_counted_by_the_scan_that_reads_the_rows(spark, tmp_path):
    columns = ["id", "age", "race", "ethnicity", "marital", "income", "coverage", "healthcare_cost", "psa", "num_encounters", "num_diagnoses", "has_died", "survival_days"]
    made = [("a", "1", "2"), ("", "1", "2"), ("b", "999", "2"), ("c", "1", "x"), ("d", "5", "5")]
    raw = spark.createDataFrame(made, "id string, age string, psa string").select(*(F.col(c) if c in ("id", "age", "psa") else F.lit("").alias(c) for c in columns))
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    valid, counted = quality.typed_rows_counted(raw)
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    valid.write.parquet(str(tmp_path / "out"))
    assert counted.get == {"rows": 5, "valid": 2, "id": 1, "age": 1, "psa": 1}
    assert sorted(map(tuple, quality.observed_counts(spark, counted).collect())) == sorted(map(tuple, quality.reject_counts(raw).collect()))


def test_parts_grow_with_the_count():
    assert [ranks.parts_for(n, 100) for n in (0, 1, 100, 101, 10_000)] == [1, 1, 1, 2, 100]


def test_places_in_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"), (F.col("id") % 4).alias("w")).union(spark.createDataFrame([(None, 2)], "x long, w long"))
    found = ranks.placed(df.repartition(5), ["x"], "w", part_rows=100)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    seen = 0
    for r in sorted(found.collect(), key=lambda r: (r["x"] is not None, r["x"] or 0)):
        assert r["before"] == seen
        seen += r["w"]
    assert ranks.placed(df.limit(0), ["x"]).count() == 0


def test_average_ranks_of_ties_in_many_ranges(spark):
    scores = spark.range(2000).select((F.col("id") % 700 / 7).alias("s"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    few, many = (sorted(map(tuple, metrics.average_ranks(scores, "s", "y", n).collect())) for n in (1_000_000, 50))
    assert few == many and few[0][3] == 2.0


def test_profile_of_values_far_from_zero(spark):
    far = spark.createDataFrame([(1e9 + i,) for i in range(3)], "x double")
    states = [ag.profile_state(far.filter(F.col("x") == 1e9 + i), ["x"]) for i in range(3)]
    whole = ag.finish_profile(ag.profile_state(far, ["x"])).first()
    pairs = ag.merge_states(ag.merge_states(states[0].union(states[1])).union(states[2]))
    for got in (whole, ag.finish_profile(pairs).first(), ag.finish_profile(ag.merge_states(states[2].union(states[0]).union(states[1]))).first()):
        assert got["variance"] == pytest.approx(1.0, abs=1e-6) and got["mean"] == 1e9 + 1 and got["n"] == 3


def test_merged_states_of_nothing(spark):
    nothing = ag.profile_state(spark.createDataFrame([(None,)], "x double"), ["x"])
    got = ag.finish_profile(ag.merge_states(nothing.union(nothing))).first()
    assert (got["n"], got["nulls"], got["mean"], got["variance"]) == (0, 2, None, None)


def counts_of(df):
    return {r["k"]: r["_times"] for r in df.collect()}


def test_bootstrap_counts_are_those_of_draws(spark):
    n, target = 3000, 60_000
    keys = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    found = counts_of(sampling.bootstrap_counts(keys, "k", target, 7, leaf_rows=20))
    assert sum(found.values()) == target and all(v > 0 for v in found.values())
    # the same at any partitioning, different with another seed
    assert counts_of(sampling.bootstrap_counts(keys.repartition(7), "k", target, 7, leaf_rows=20)) == found
    assert counts_of(sampling.bootstrap_counts(keys, "k", target, 8, leaf_rows=20)) != found
    mean = target / n
    square = sum((found.get(f"k{i}", 0) - mean) ** 2 for i in range(n)) / mean
    # chi-square with n - 1 degrees of freedom: within five standard deviations
    assert abs(square - (n - 1)) < 5 * np.sqrt(2 * (n - 1))
    plan = sampling.bootstrap_counts(keys, "k", target, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan


def test_bootstrap_beyond_32_bits_and_below_the_top_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TOP_DIGITS", 1)
    keys = spark.range(500).select(F.col("id").alias("k"))
    target = 20_000_000_000
    found = counts_of(sampling.bootstrap_counts(keys, "k", target, 1, leaf_rows=5))
    assert sum(found.values()) == target and len(found) == 500
    mean = target / 500
    assert max(abs(v - mean) for v in found.values()) < 6 * np.sqrt(mean)


def test_rows_without_a_key_cannot_be_drawn(spark):
    with pytest.raises(ValueError, match="1 rows have no k"):
        sampling.bootstrap_counts(spark.createDataFrame([(1,), (None,)], "k long"), "k", 10, 1)


def test_one_row_takes_all_draws(spark):
    one = spark.range(1)
    assert sampling.resize(one, "id", 9).count() == 9
    assert sampling.resize(spark.range(6), "id", 6).count() == 6


def test_binomial_numbers_by_hash_have_the_right_mean_and_variance():
    from hashlib import md5

    drawn = np.array([sampling.draws_of_one(300, 100, md5(str(i).encode()).hexdigest(), 1) for i in range(20_000)])
    assert abs(drawn.mean() - 3) < 0.06 and abs(drawn.var() - 300 * 0.01 * 0.99) < 0.15
    assert sampling.split_draws(10, [0, 3, 0], "x") == [0, 10, 0]


def test_reuse_on_the_requests_own_clock(spark, tmp_path):
    made = [("a", 0, 1), ("a", 59, 2), ("a", 60, 3), ("b", 10, 4), ("a", 119, 5), ("b", 500, 6), ("b", 501, 7), ("a", 900, 8), ("a", 900, 9)]
    for part in (made[:4], made[4:7], made[7:]):
        df = spark.createDataFrame(part, "key string, s long, id long").select("key", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("at"), "id")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    try:
        stream = jobs.file_stream(spark, df.schema, str(tmp_path / "in"))
        hits = jobs.reuse_on_clock(stream, "key", "at", "id", 60_000, "1 minute")
        jobs.run_available(hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else None
    found = {r["id"]: r["hit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False, 9: True}


def test_timed_telemetry_stops_by_itself(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("double").alias("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, "ms double", str(tmp_path / "in"))
    table, triggers = jobs.telemetry_run(stream, "ms", "timed_test", str(tmp_path / "state"), "0.2 seconds")
    assert [tuple(r) for r in table.collect()] == [(30, 14.5)]
    assert sorted(map(tuple, triggers.collect())) == [(0, 10), (1, 10), (2, 10)]
    assert not [q for q in spark.streams.active if q.name == "timed_test"]

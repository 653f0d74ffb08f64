"""Streams of events in three batches, run to their end, against the same result by a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import finish_profile
from ..operators.joins import ScoreStore
from ..operators.ranks import parts_for
from ..plans import training
from ..staging import scratch_folder
from ..streaming import jobs
from .learning import FIXED, SCORED_SQL
from .registry import LINES, lines, query, rounded, table

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
REQUESTS_SQL = "SELECT event_id, event_type, user_id, value, ts FROM events"


#: Rows that a file of a stream is meant to hold, which one task writes.
FILE_ROWS = 1_000_000


def _stream(spark: SparkSession, df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` written as files and read as a stream of three batches; ``rows``, about how many there are, gives the files of a batch."""
    path, files = scratch_folder(spark, name), parts_for(rows, 3 * FILE_ROWS)
    df.repartition(3 * files).write.parquet(path)
    return jobs.file_stream(spark, df.schema, path, files)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _stream(spark, events.select("event_id", "event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("ts")), "events", events.count())


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


@query(f"WITH {SCORED_SQL} SELECT id, round(risk, 8) AS risk, round(survival, 4) AS survival, round(cost, 4) AS cost FROM scored")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a stream, scored and appended to a log."""
    stream = _stream(spark, lines(spark, sf_dir), "lines", table(spark, sf_dir, "lineitem").count())
    path = scratch_folder(spark, "scores")
    scored = lambda batch: training.score(jobs.with_default_id(batch), FIXED, LINES).select("id", "risk", "survival", "cost")
    jobs.run_available(jobs.append_batches(stream, scored, path, scratch_folder(spark, "state")))
    return rounded(spark.read.parquet(path).drop("batch"), risk=8, survival=4, cost=4)


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_risk, round(avg(value * 2), 6) AS mean_survival, round(avg(value + user_id), 6) AS mean_cost FROM events")
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _events(spark, sf_dir).select(F.col("value").alias("risk"), (F.col("value") * 2).alias("survival"), (F.col("value") + F.col("user_id")).alias("cost"))
    found = jobs.memory_result(jobs.running_statistics(scores), _name("stats"), "complete", scratch_folder(spark, "state"))
    return rounded(found, mean_risk=6, mean_survival=6, mean_cost=6)


@query("SELECT count(*) AS requests, round(sum(value) / count(*), 6) AS mean_latency FROM events")
def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.memory_result(jobs.telemetry(_events(spark, sf_dir), "value"), _name("telemetry"), "complete", scratch_folder(spark, "state"))
    return rounded(found, mean_latency=6)


@query("SELECT count(*) AS requests, round(sum(value) / count(*), 6) AS mean_latency, 3::BIGINT AS triggers, count(*) AS reported FROM events")
def stream_telemetry_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry on a timed trigger, one file a trigger, with what the triggers reported."""
    found, triggers = jobs.telemetry_run(_events(spark, sf_dir), "value", _name("timed"), scratch_folder(spark, "state"), "0.2 seconds")
    totals = triggers.agg(F.count("*").alias("triggers"), F.sum("requests").alias("reported"))
    return rounded(found.crossJoin(totals), mean_latency=6)


@query("SELECT DISTINCT event_type, round(value, 0) AS value FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First request of each key within a time to live that outlasts the data; rows go to a table."""
    keyed = _events(spark, sf_dir).select("event_type", F.round("value", 0).alias("value"), F.concat_ws("|", "event_type", F.round("value", 0)).alias("key"), "ts")
    first = jobs.first_in_ttl(keyed, "key", "ts", "3650 days").select("event_type", "value")
    path = scratch_folder(spark, "first")
    jobs.run_available(first.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_folder(spark, "state")))
    return spark.read.schema(first.schema).parquet(path)


def _by_thirds(spark: SparkSession, events: DataFrame) -> DataFrame:
    """``events`` as a stream of three batches, the thirds of their span of time (column ts)."""
    path = scratch_folder(spark, "requests")
    low, high = events.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    third = F.floor((F.unix_millis("ts") - F.lit(low)) * 3 / F.lit(high - low + 1))
    counts = [r["count"] for r in events.groupBy(third).count().collect()]
    # a batch is so many files: as many as the largest third asks for, none of which is empty in the smallest
    parts = max(4, min(parts_for(max(counts), FILE_ROWS), min(counts) // 1000))
    for i in range(3):  # a stream takes files in the order of their age
        events.filter(third == i).repartition(parts).write.mode("append").parquet(path)
    return jobs.file_stream(spark, events.schema, path, parts)


#: How long a stored score is good: less than two thirds of the events' span, more than one.
STREAM_TTL_DAYS = 15
STREAM_MEMO_SQL = f"""WITH e AS (SELECT event_id, event_type, round(value, 0) AS value, epoch_ms(ts) AS ms FROM events),
b AS (SELECT *, ((ms - (SELECT min(ms) FROM e)) * 3 // ((SELECT max(ms) - min(ms) FROM e) + 1)) AS batch FROM e),
clock AS (SELECT batch, min(ms) // 1000 AS now FROM b GROUP BY batch),
w0 AS (SELECT DISTINCT event_type, value, now FROM b JOIN clock USING (batch) WHERE batch = 0),
live1 AS (SELECT event_type, value FROM w0 WHERE now + {STREAM_TTL_DAYS * 86_400} > (SELECT now FROM clock WHERE batch = 1)),
w1 AS (SELECT DISTINCT event_type, value, now FROM b JOIN clock USING (batch) WHERE batch = 1 AND (event_type, value) NOT IN (SELECT (event_type, value) FROM live1)),
live2 AS (SELECT event_type, value FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1) WHERE now + {STREAM_TTL_DAYS * 86_400} > (SELECT now FROM clock WHERE batch = 2))
SELECT event_id, batch, length(event_type) * 1000 + value AS score,
       CASE batch WHEN 0 THEN false WHEN 1 THEN (event_type, value) IN (SELECT (event_type, value) FROM live1) ELSE (event_type, value) IN (SELECT (event_type, value) FROM live2) END AS hit FROM b"""


@query(STREAM_MEMO_SQL)
def stream_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream scored through a store of scores that expire by the requests' own time."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 0).alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    store = ScoreStore(spark, scratch_folder(spark, "store"), STREAM_TTL_DAYS * 86_400, buckets=8)
    out = scratch_folder(spark, "scored")

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.length("event_type") * 1000 + F.col("value"))

    def now(batch: DataFrame) -> int:
        return batch.agg(F.min(F.unix_seconds("ts"))).first()[0]

    jobs.run_available(jobs.score_with_store(_by_thirds(spark, events), ["event_type", "value"], store, score, now, out, scratch_folder(spark, "state")))
    store.table.drop()
    return spark.read.parquet(out).select("event_id", F.col("batch").cast("bigint").alias("batch"), "score", "hit")


#: How long a computed result is good, in days of the events' own time.
REUSE_DAYS = 2
REUSE_SQL = f"""WITH RECURSIVE s AS (SELECT event_id, concat_ws('|', event_type, user_id) AS key, epoch_ms(ts) AS ms FROM events),
written AS (
  SELECT key, min(ms) AS ms FROM s GROUP BY key
  UNION ALL SELECT w.key, min(s.ms) FROM written w JOIN s ON s.key = w.key AND s.ms >= w.ms + {REUSE_DAYS * 86_400_000} GROUP BY w.key),
computed AS (SELECT min(event_id) AS event_id FROM s JOIN written USING (key, ms) GROUP BY key, ms)
SELECT event_id, event_id NOT IN (SELECT event_id FROM computed) AS hit FROM s"""


@query(REUSE_SQL)
def stream_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order of time, in batches: whether each finds a result that has not expired."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", "event_type", "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_folder(spark, "hits")
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, jobs.STATE_STORE)
    try:
        hits = jobs.reuse_on_clock(_by_thirds(spark, events), "key", "ts", "event_id", REUSE_DAYS * 86_400_000)
        jobs.run_available(hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_folder(spark, "state")))
    finally:
        spark.conf.unset(STATE_PROVIDER) if before is None else spark.conf.set(STATE_PROVIDER, before)
    return spark.read.schema("id long, hit boolean").parquet(out).select(F.col("id").alias("event_id"), "hit")


@query("SELECT 'value' AS col, count(value) AS n, count(*) - count(value) AS nulls, 0.0::DOUBLE AS null_pct, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM events")
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "profile")
    jobs.run_available(jobs.profile_batches(_events(spark, sf_dir), ["value"], path, scratch_folder(spark, "state")))
    return rounded(finish_profile(jobs.merged_profile(spark, path)), null_pct=6, mean=6, variance=4, std=6)

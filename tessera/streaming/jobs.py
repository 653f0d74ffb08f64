"""Structured Streaming counterparts: scoring, running statistics, telemetry, reuse, profiles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.aggregates import merge_states, profile_state
from ..operators.joins import ScoreStore

DEFAULT_ID = "API-REQUEST"
TELEMETRY_EVERY = "1.5 seconds"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, schema, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_default_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(F.col(column), F.lit("")) == "", DEFAULT_ID).otherwise(F.col(column)))


def append_batches(stream: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch, changed, is written under its batch id: a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def score_with_store(
    stream: DataFrame, features: Sequence[str], store: ScoreStore, score: Callable[[DataFrame], DataFrame], now: Callable[[DataFrame], int], path: str, checkpoint: str
) -> DataStreamWriter:
    """Each micro-batch is scored by ``ScoreStore.score`` and written, with score and hit, under its batch id.

    ``now`` gives the time of a batch in seconds, from the batch itself, so that one that is run again finds the same live
    entries; it replaces its rows in the log and its entries in the store.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                found = store.score(batch, features, score, f"batch-{batch_id}", now(batch))
                found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running_statistics(scores: DataFrame, watermark: str | None = None, time: str = "at", window: str | None = None) -> DataFrame:
    """Rows so far and mean risk, survival and cost; zeros before the first row.

    With ``window`` (our addition) the same for each tumbling window of event time, late rows up to the watermark.
    """
    aggs = [F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("risk", "survival", "cost"))]
    if window is None:
        return scores.agg(*aggs)
    timed = scores.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, watermark or window).groupBy(F.window(time, window)).agg(*aggs)


def telemetry(requests: DataFrame, latency: str) -> DataFrame:
    """Rows so far and mean latency as a ratio of sums."""
    return requests.agg(F.count("*").alias("requests"), F.coalesce(F.sum(latency) / F.count("*"), F.lit(0.0)).alias("mean_latency"))


def report_telemetry(requests: DataFrame, latency: str, name: str, checkpoint: str, every: str = TELEMETRY_EVERY) -> StreamingQuery:
    """Keep the table ``name`` at the latest telemetry, brought up to date ``every`` so often until the query is stopped."""
    writer = telemetry(requests, latency).writeStream.format("memory").queryName(name).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def telemetry_run(requests: DataFrame, latency: str, name: str, checkpoint: str, every: str = TELEMETRY_EVERY) -> tuple[DataFrame, DataFrame]:
    """``report_telemetry`` on its timed trigger until all that the source holds is reported: the table, and (trigger, requests) of
    each trigger that met some, as the query's own progress reports give them (the latest ones that Spark keeps)."""
    query = report_telemetry(requests, latency, name, checkpoint, every)
    try:
        query.processAllAvailable()
        met = [(p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    spark = requests.sparkSession
    return spark.table(name), spark.createDataFrame(met, "trigger long, requests long")


def first_in_ttl(stream: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """Rows whose key was not seen within ``ttl`` of event time; state goes as the watermark passes."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def reuse_with_ttl(stream: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """(key, requests, computed) for each key and batch: a key's result is computed when it has no
    live entry and is reused for ``ttl_ms`` of processing time after it was written.  Needs ``STATE_STORE``."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Reuse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", "n bigint", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n = sum(len(r) for r in rows)
            computed = 0 if self.known.exists() else 1
            if computed:
                self.known.update((n,))
            yield pd.DataFrame({"key": [key[0]], "requests": [n], "computed": [computed]})

        def close(self) -> None:
            pass

    grouped = stream.select(F.col(key).alias("key")).groupBy("key")
    return grouped.transformWithStateInPandas(Reuse(), "key string, requests bigint, computed bigint", "Append", "ProcessingTime")


#: Groups of keys whose results ``reuse_on_clock`` keeps together.
REUSE_BUCKETS = 1024


def reuse_on_clock(stream: DataFrame, key: str, time: str, id: str, ttl_ms: int, late: str = "1 hour", buckets: int = REUSE_BUCKETS) -> DataFrame:
    """(id, hit) of each request: whether its key has a result that was computed less than ``ttl_ms`` before, by the requests' own time.

    A request without a live result computes one, which is good for ``ttl_ms`` from then, however often it is used.  Keys are
    hashed to ``buckets`` (one number for the life of a checkpoint), whose state is read and written as a whole, as calls to the
    state store cost far more than rows do.  State is one time a key; a timer removes it when the watermark, ``late`` behind the
    latest request, has passed its end.  Of one batch of a bucket only keys, times and ids are held.  Requests that come after the
    watermark are left out, as in any such stream.  Needs ``STATE_STORE``.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Reuse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.written = handle.getListState("written", "key string, at bigint")

        def keep(self, known: dict[str | None, int], timerValues) -> None:
            """State of the results that are good beyond the watermark, and the timer of the first to end."""
            watermark = timerValues.getCurrentWatermarkInMs()
            good = [(k, at) for k, at in known.items() if at + ttl_ms > watermark]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if good:
                self.written.put(good)
                self.handle.registerTimer(min(at for _, at in good) + ttl_ms)
            else:
                self.written.clear()

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = {k: at for k, at in self.written.get()} if self.written.exists() else {}
            found = pd.concat(list(rows), ignore_index=True).sort_values(["key", "at", "id"], ignore_index=True)
            codes, keys = pd.factorize(found["key"], use_na_sentinel=False)
            ends = np.cumsum(np.bincount(codes))
            times, hit, start = found["at"].tolist(), np.ones(len(found), bool), 0
            for name, stop in zip(keys, ends.tolist(), strict=True):
                name = name if isinstance(name, str) else None
                at = known.get(name)
                end = start if at is None else bisect_left(times, at + ttl_ms, start, stop)
                # from one computed result to the next: the first request at or after its end
                while end < stop:
                    hit[end], at = False, times[end]
                    end = bisect_left(times, at + ttl_ms, end, stop)
                known[name], start = at, stop
            self.keep(known, timerValues)
            yield pd.DataFrame({"id": found["id"], "hit": hit})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.keep({k: at for k, at in self.written.get()} if self.written.exists() else {}, timerValues)
            yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype="bool")})

        def close(self) -> None:
            pass

    timed = stream.select(F.col(key).cast("string").alias("key"), F.col(id).cast("bigint").alias("id"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", late)
    grouped = timed.withColumn("at", F.unix_millis("time")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")
    return grouped.transformWithStateInPandas(Reuse(), "id bigint, hit boolean", "Append", "EventTime")


def profile_batches(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str) -> DataStreamWriter:
    """Profile state of each micro-batch; ``merged_profile`` adds them up."""
    return append_batches(stream, lambda batch: profile_state(batch, columns), path, checkpoint)


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    return merge_states(spark.read.parquet(path))


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def memory_result(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run what is available of a stream with a small result and return the result."""
    run_available(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint))
    return df.sparkSession.table(name)

"""Lookups of per-key aggregates, and scoring that reuses what was scored before."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import feature_key
from ..sources.keyed import BATCH, KeyedTable


def left_join_lookups(base: DataFrame, key: str, lookups: Sequence[DataFrame], defaults: Mapping[str, object]) -> DataFrame:
    """``base`` with the columns of each lookup (unique by its first column); no match gives the default."""
    for lookup in lookups:
        their_key = lookup.columns[0]
        base = base.join(lookup.withColumnRenamed(their_key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return base.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def memoised_scores(requests: DataFrame, features: Sequence[str], known: DataFrame, score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(requests with score and hit, the new known scores).

    Rows are looked up in ``known`` (key, score) by a key of all features; ``score`` is applied to
    one row of each unknown key (a column "score" is added) and its result joined back.
    """
    keyed = requests.withColumn("key", feature_key([F.col(c) for c in features]))
    distinct = keyed.groupBy("key").agg(*(F.first(c).alias(c) for c in features))
    fresh = score(distinct.join(known, "key", "left_anti")).select("key", "score")
    everything = known.select("key", "score", F.lit(True).alias("hit")).unionByName(fresh.withColumn("hit", F.lit(False)))
    return keyed.join(everything, "key").drop("key"), known.select("key", "score").unionByName(fresh)


class ScoreStore:
    """Scores that outlive a job: a keyed table of (key, score, written), each entry good for ``ttl`` seconds after it was written.

    ``now`` is given by the caller, in seconds, so a batch that is run again sees what it saw before.
    """

    SCHEMA = T.StructType().add("key", "string").add("score", "double").add("written", "long")

    def __init__(self, spark: SparkSession, path: str, ttl: int, buckets: int = 32):
        self.table, self.ttl = KeyedTable(spark, path, self.SCHEMA, "key", buckets), ttl

    def live(self, now: int, without: str | None = None) -> DataFrame:
        """(key, score) of the entries written up to ``now`` that have not expired, the latest of a key."""
        good = self.table.read(without).filter((F.col("written") <= now) & (F.col("written") + self.ttl > now))
        # grouped within buckets, without a shuffle
        return good.groupBy("key").agg(F.max_by("score", "written").alias("score"))

    def score(self, requests: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], batch: str, now: int) -> DataFrame:
        """``requests`` with score and hit (a live entry of another batch had it).

        ``score`` (which adds a column "score") is applied to one row of each key without a live entry, and what it gives
        is written under ``batch`` before it is used.  Requests of a key that a third of all rows have are one row a task
        after the grouping, and meet their score in a plain shuffle that adaptive execution can split.
        """
        keyed = requests.withColumn("_key", feature_key([F.col(c) for c in features]))
        distinct = keyed.groupBy(F.col("_key").alias("key")).agg(*(F.first(c).alias(c) for c in features))
        known = self.live(now, batch)
        fresh = score(distinct.join(known.hint("merge"), "key", "left_anti"))
        self.table.put(batch, fresh.select("key", "score", F.lit(now).cast("long").alias("written")))
        scores = known.withColumn("hit", F.lit(True)).unionByName(self.table.read_batch(batch).select("key", "score", F.lit(False).alias("hit")))
        return keyed.join(scores, F.col("_key") == F.col("key")).drop("_key", "key")

    def expire(self, now: int) -> list[str]:
        """Remove the batches of which no entry is good any more."""
        last = self.table.read().groupBy(BATCH).agg(F.max("written").alias("last"))
        gone = sorted(r[BATCH] for r in last.filter(F.col("last") + self.ttl <= now).collect())
        for batch in gone:
            self.table.forget(batch)
        return gone

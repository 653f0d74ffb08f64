"""Exact deduplication against a persistent digest index.

The index is a table of one row per distinct text (digest, the document that stays, the
batch that added it), bucketed and sorted by digest, at a path of its own, where any later session finds it.  New data is
reduced to one row per digest, dealt as the index is, compared with it by a sort-merge anti-join (the index side is not
shuffled), and what is new is appended in the same layout.  A batch that is taken again under its name meets the index
without itself and replaces itself, so a job that failed at any point may simply be run again.

Only digests are shuffled, never texts.  A text that a third of all rows carry is one row per
task after the partial aggregate; where single rows are joined back, both sides are plain
shuffles, which adaptive execution splits.

Cases: a null text counts as empty; empty texts are equal to each other; a null id is smaller
than any other; of repeated rows (same id and text) exactly one is kept; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from ..sources.keyed import KeyedTable
from .staging import staged
from .text import ascii_lower, whole_row

#: Distinct texts that a bucket of the index is meant to hold, about.
TEXTS_A_BUCKET = 2_000_000

INDEX_SCHEMA = T.StructType().add("text_sha256", "string").add("keep_id", "long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own) and text_sha256 of every row of ``docs`` (doc_id, text), written."""
    return staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"),
        ),
        "digests",
    )


class DigestIndex:
    """The digests of all texts taken in so far, at ``path`` (a plain name is a folder in the session's shared folder).

    ``buckets`` is fixed when the index is made; ``buckets_for`` gives a number for the texts expected.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path if "/" in path else f"{shared_dir(spark)}/{path}", buckets
        self._table: KeyedTable | None = None

    @staticmethod
    def buckets_for(texts: int) -> int:
        return max(32, -(-texts // TEXTS_A_BUCKET))

    @property
    def table(self) -> KeyedTable:
        """Opened, or made, when it is first needed."""
        if self._table is None:
            self._table = KeyedTable(self.spark, self.path, INDEX_SCHEMA, "text_sha256", self.buckets)
        return self._table

    @property
    def name(self) -> str:
        """What the catalog of this session calls the index."""
        return self.table.name

    def read(self, without: str | None = None) -> DataFrame:
        return self.table.read(without)

    def drop(self) -> None:
        self.table.drop()
        self._table = None

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Take in ``docs`` (doc_id, text) and return one row for each of them.

        doc_id, keep_id (the document that stays for this text), group_size (rows of ``docs``
        with this text), kept, text_sha256, known (another batch of the index has the text).
        A document of the index stays before any new one; among new ones, the largest doc_id.
        A ``batch`` that has a name may be taken again.
        """
        return self.take(digests(docs), batch)

    def take(self, found: DataFrame, batch: str | None = None) -> DataFrame:
        """``ingest`` for rows of ``digests``."""
        return _decided(found, self._taken(found, batch)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "known")

    def _taken(self, found: DataFrame, batch: str | None) -> DataFrame:
        """Take in the digests of ``found``: text_sha256, group_size, keep_id, keep_row (null if known) and known of each, written."""
        batch = batch or uuid.uuid4().hex
        groups = found.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        # one row a digest, dealt as the index is, so that the index itself is never shuffled
        buckets = self.table.buckets
        groups = staged(groups, "groups").repartition(buckets, "text_sha256")
        earlier = self.read(batch)
        fresh = groups.join(earlier.hint("merge"), "text_sha256", "left_anti")
        self.table.put(batch, fresh.select("text_sha256", F.col("keep.doc_id").alias("keep_id")), dealt=True)
        met = groups.join(earlier.select("text_sha256", F.col("keep_id").alias("its_id"), F.lit(True).alias("known")).hint("merge"), "text_sha256", "left")
        known = F.coalesce("known", F.lit(False))
        return staged(
            met.select(
                "text_sha256",
                "group_size",
                F.when(known, F.col("its_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
                F.when(~known, F.col("keep.row")).alias("keep_row"),
                known.alias("known"),
            ),
            "taken",
        )

    def take_halves(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Take in ``docs`` as two batches, the larger ids first: the second batch meets what the first one added.

        As an indexed document stays, the largest id of equal texts stays over both.  Rows as ``ingest`` gives them,
        with group_size over both batches and without known.
        """
        batch = batch or uuid.uuid4().hex
        found = digests(docs)
        low, high = found.agg(F.min("doc_id"), F.max("doc_id")).first()
        first = F.coalesce(F.col("doc_id") > (low + high) // 2, F.lit(False)) if low is not None else F.lit(False)
        larger, smaller = self._taken(found.filter(first), f"{batch}.1"), self._taken(found.filter(~first), f"{batch}.2")
        # one row a digest: what the first batch decided holds for the second one, and their sizes add up
        again = smaller.select("text_sha256", *(F.col(c).alias(f"_{c}") for c in smaller.columns[1:]))
        both = larger.join(again, "text_sha256", "full")
        mine = F.col("group_size").isNotNull()
        taken = both.select(
            "text_sha256",
            (F.coalesce("group_size", F.lit(0)) + F.coalesce("_group_size", F.lit(0))).alias("group_size"),
            *(F.when(mine, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("keep_id", "keep_row", "known")),
        )
        return _decided(found, staged(taken, "taken")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(found: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of ``digests`` with what was decided about their texts.

    ``taken`` is a written table, so both sides are shuffled and a digest with very many rows can be split.
    """
    kept = F.when(F.col("known"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.col("row") == F.col("keep_row"))
    return found.join(taken, "text_sha256").withColumn("kept", kept)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``ingest`` kept, with all their columns.

    ``docs`` is shuffled by id and digest once; of repeated rows (same id and text) one stays.
    """
    keepers = decided.filter("kept").select(F.col("doc_id").alias("its_id"), F.col("text_sha256").alias("its_digest"))
    marked = docs.select(whole_row(docs), "doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("digest"))
    joined = marked.join(keepers, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("digest"))
    return joined.withColumn("nth", one).filter("nth = 1").select("row.*")

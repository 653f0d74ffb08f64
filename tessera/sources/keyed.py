"""Tables kept at a path of their own, bucketed by a key and written batch by batch.

Rows of a batch are one partition folder, with one file a bucket, sorted by the key.  A batch that is written again replaces
itself, so a job that is run again after a failure changes nothing.  A join or a grouping by the key meets the table in its
buckets and does not shuffle it.  What a later session needs to know about the table (key, columns, buckets) lies beside
the rows; the catalog only gets a name for the path and may forget it.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = "_layout"
BATCH = "batch"


class KeyedTable:
    """The table at ``path``.  ``schema``, ``key`` and ``buckets`` are needed where there is none yet, and then made known."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, key: str | None = None, buckets: int = 32):
        self.spark, self.path = spark, path
        place, store = self._place(path)
        # one name however the path is written
        self.path = store.makeQualified(place).toString()
        found = self._layout()
        if found is None:
            if schema is None or key is None:
                raise FileNotFoundError(f"no keyed table at {path}")
            found = {"key": key, "buckets": buckets, "schema": schema.jsonValue()}
            spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(f"{self.path}/{LAYOUT}")
        self.key, self.buckets = found["key"], found["buckets"]
        self.schema = T.StructType.fromJson(found["schema"])
        if (schema is not None and schema.simpleString() != self.schema.simpleString()) or key not in (None, self.key):
            raise ValueError(f"the table at {path} has another key or other columns")
        self.name = f"keyed_{sha256(self.path.encode()).hexdigest()[:24]}"
        self._register()

    def _place(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _layout(self) -> dict | None:
        place, store = self._place(f"{self.path}/{LAYOUT}/_SUCCESS")
        return json.loads(self.spark.read.text(f"{self.path}/{LAYOUT}").first()[0]) if store.exists(place) else None

    def _register(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {BATCH} string) USING parquet PARTITIONED BY ({BATCH}) "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        self.refresh()

    def refresh(self) -> None:
        """Learn of batches that other applications have put or removed since the table was opened."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")

    def read(self, without: str | None = None) -> DataFrame:
        """All rows with their batch; ``without`` leaves one batch out, by its folder."""
        rows = self.spark.table(self.name)
        return rows if without is None else rows.filter(F.col(BATCH) != without)

    def read_batch(self, batch: str) -> DataFrame:
        return self.spark.table(self.name).filter(F.col(BATCH) == batch)

    def put(self, batch: str, rows: DataFrame, dealt: bool = False) -> None:
        """Make ``rows`` the rows of ``batch``, whether or not it was written before.

        Rows are dealt as the buckets are, so each bucket is one sorted file.  They may come from other batches of the
        table.  What is left of an earlier attempt is removed first; a batch is there once its ``put`` has ended.
        ``dealt``: the rows are in partitions by the hash of the key already, as many as there are buckets.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if batch in self.batches():
            self.forget(batch)
        rows = rows.select(*(f.name for f in self.schema))
        rows = rows if dealt else rows.repartition(self.buckets, self.key)
        rows.withColumn(BATCH, F.lit(batch)).write.insertInto(self.name)

    def batches(self) -> list[str]:
        return sorted(r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def forget(self, batch: str) -> None:
        """Remove a batch with its files."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({BATCH} = '{batch}')")
        place, store = self._place(f"{self.path}/{BATCH}={batch}")
        store.delete(place, True)

    def drop(self) -> None:
        """Remove the table with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        place, store = self._place(self.path)
        store.delete(place, True)

"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
from typing import Any

from pyspark.sql import DataFrame

from ..session import scratch_path, ship_package

#: What is written and not released yet: path, and the file system settings to remove it with.
_written: dict[str, Any] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    This cuts the lineage: what is written survives the loss of any executor.  ``release`` removes the files
    when nothing that reads them is to run any more; the rest are removed when the Python process ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of ``tables`` (as returned by ``staged``)."""
    for df in tables:
        _remove(df._staged_path)


def _remove(path: str) -> None:
    conf = _written.pop(path, None)
    if conf is not None:
        from pyspark import SparkContext

        place = SparkContext._jvm.org.apache.hadoop.fs.Path(path)  # outlives a stopped session
        place.getFileSystem(conf).delete(place, True)


def _remove_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception as e:  # the Java process may have ended first; the folder belongs to the cluster
            print(f"tessera: {path} is left behind: {type(e).__name__}")

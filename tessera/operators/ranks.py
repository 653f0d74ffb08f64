"""Global order without a global task: rows are dealt by ranges, counted by task, and placed by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import release, staged

#: Rows that one task is meant to place.
PART_ROWS = 1_000_000


def parts_for(rows: int, part_rows: int = PART_ROWS) -> int:
    """Range partitions for so many rows; they grow with the count."""
    return max(1, -(-rows // part_rows))


def placed(df: DataFrame, order: Sequence[str], weight: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` (written) with ``before``: the sum of ``weight`` (a whole number of rows, 1 if None) over all rows earlier in ``order``.

    Rows are counted first, dealt by as many ranges of ``order`` as their number asks for, and summed up within each range as
    they stream by in order; what lies before a range is a prefix sum over one row a range.  ``order`` must tell all rows
    apart where ``before`` is to be the same in every run.  Nulls come first and NaN last, as Spark orders them.
    """
    rows = staged(df, "rows")
    columns = rows.columns
    ranged = rows.repartitionByRange(parts_for(rows.count(), part_rows), *order).sortWithinPartitions(*order)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            weights = np.ones(n, np.int64) if weight is None else np.asarray(batch.column(weight))
            sums = seen + np.cumsum(weights)
            added = [pa.array([part] * n, pa.int32()), pa.array(sums - weights, pa.int64()), pa.array(weights, pa.int64())]
            seen = int(sums[-1]) if n else seen
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "_part", "_within", "_weight"])

    summed = staged(ranged.mapInArrow(add_up, _with(rows, "_part int, _within long, _weight long")), "summed")
    release(rows)
    totals = summed.groupBy("_part").agg(F.sum("_weight").alias("_all"))
    # one row a range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    return summed.join(starts, "_part").select(*columns, (F.col("_start") + F.col("_within")).alias("before"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])

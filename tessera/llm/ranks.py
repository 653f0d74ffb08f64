"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are ranked together by one task, about.  It decides about the division of work, never about an order.
BLOCK_ROWS = 200_000


def ranked(df: DataFrame, within: list[str], along: list[str], ties: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``rank`` (from 0) within each group of the ``within`` columns.

    Rows are ordered by the ``along`` columns, then by the MD5 of the ``ties`` (joined by |, null empty), then by the
    ties themselves.  A group is ranked in parts: rows that agree in within and along, and where these are more than
    ``block_rows``, ranges of the MD5's leading 32 bits.  Ranges follow the order, so it is the same however many there
    are.  Parts are counted and the counts prefix-summed, so no task gets more than one part; only rows that agree in
    all ties cannot be parted.  The columns of ``within`` and ``along`` must not hold nulls.
    """
    keys = [*within, *along]
    # at most rows / block_rows keys are that large, which bounds what is broadcast
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows)
    large = large.select(*keys, F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("long").alias("_parts"))
    mixed = F.md5(F.concat_ws("|", *(F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ties)).cast("binary"))
    parts = df.withColumn("_mixed", mixed).join(F.broadcast(large), keys, "left")
    leading = F.conv(F.substring("_mixed", 1, 8), 16, 10).cast("long")
    parts = parts.withColumn("_part", F.shiftright(leading * F.coalesce("_parts", F.lit(1).cast("long")), 32)).drop("_parts")
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_in"))
    earlier = Window.partitionBy(*within).orderBy(*along, "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    in_part = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_mixed", *ties)) - 1
    placed = parts.withColumn("_nth", in_part).join(starts, [*keys, "_part"])
    return placed.withColumn("rank", (F.col("_before") + F.col("_nth")).cast("long")).drop("_nth", "_before", "_part", "_mixed")

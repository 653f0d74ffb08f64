"""Splits, exact resizing and ids that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import release, staged


def split_hash_value(seed: int, key: Column) -> Column:
    """First 8 hex digits of md5(seed, key)."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 8)


def in_test(seed: int, key: Column, fraction: float) -> Column:
    """Whether a row belongs to the test part: a hash against the fraction, a narrow filter."""
    return F.conv(split_hash_value(seed, key), 16, 10).cast("bigint") % 10000 < round(fraction * 10000)


def split_exact(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``df`` with is_test; exactly int(n * fraction) rows, those with the smallest hash.

    The hash that parts the two is found by counting rows by their first hash digits, then ordering
    only the digits group that holds the border.
    """
    n = df.count()
    wanted = int(n * fraction)
    hashed = df.withColumn("_h", F.concat(split_hash_value(seed, F.col(key)), F.lit("|"), F.col(key).cast("string")))
    border = smallest_border(hashed, "_h", wanted)
    test = F.lit(False) if border is None else F.col("_h") <= border
    return hashed.withColumn("is_test", test).drop("_h")


def smallest_border(df: DataFrame, column: str, wanted: int, digits: int = 4) -> str | None:
    """The ``wanted``-th smallest string of a unique column; null for none.

    Counts by prefix (at most 16 ** digits rows on the driver) tell the group that holds it.
    """
    if wanted <= 0:
        return None
    seen = 0
    for prefix, n in df.groupBy(F.substring(column, 1, digits).alias("p")).count().orderBy("p").collect():
        if seen + n >= wanted:
            group = df.filter(F.substring(column, 1, digits) == prefix).select(column)
            return group.orderBy(column).limit(wanted - seen).agg(F.max(column)).first()[0]
        seen += n
    return df.agg(F.max(column)).first()[0]


#: Rows that one task is meant to number.
GROUP_ROWS = 1_000_000


def dense_index(df: DataFrame, key: str, name: str = "index", rows: int = 0) -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of the hash of ``key`` (a unique column), then of the key.

    Rows are numbered within groups of equal leading hash digits, and group counts are added up, so no task orders all
    rows.  ``rows``, about how many there are, gives the number of groups (256 at least), not the order.
    """
    digits = 2
    while GROUP_ROWS * 16**digits < rows:
        digits += 1
    hashed = F.md5(F.col(key).cast("string").cast("binary"))
    group = F.substring(hashed, 1, digits)
    dealt = df.withColumn("_group", group)
    counts = dealt.groupBy("_group").agg(F.count("*").alias("_n"))
    starts = counts.select("_group", F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_group").orderBy(hashed, key)) - 1
    return dealt.withColumn("_nth", nth).join(starts, "_group").withColumn(name, (F.col("_start") + F.col("_nth")).cast("bigint")).drop("_group", "_nth", "_start")


def resize(df: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """Exactly ``target`` rows of ``df``: a sample without replacement, or a bootstrap with it."""
    return _copies(df, key, target, seed).select(*df.columns)


def _copies(df: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    """``resize`` with _each, which numbers the copies of a row from 1."""
    n = df.count()
    if n == 0:
        raise ValueError("the table to resize is empty")
    if n >= target:
        return (df if n == target else split_exact_count(df, key, target, seed)).withColumn("_each", F.lit(1).cast("bigint"))
    # a row joins its count, so the join meets each row once
    return df.join(bootstrap_counts(df, key, target, seed), key).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times")


#: Draws that are made one by one; more are split down a tree of hash prefixes.
DRAWN = 100_000_000
#: Rows that share the draws of a leaf of that tree, about.
LEAF_ROWS = 10_000
#: Hex digits of the part of the tree that the driver splits: 65,536 counts at most.
TOP_DIGITS = 4
#: Draws a row beyond which a count is not found by adding up probabilities.
MANY = 256


def bootstrap_counts(df: DataFrame, key: str, target: int, seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, _times): how often each row is drawn in ``target`` draws with replacement, rows that are drawn at all.

    Up to ``DRAWN`` draws are made one by one: draw i (from 0) takes the row at place floor(u * rows) of ``dense_index``, where
    u is the first 13 hex digits of md5("seed|draw|i") over 2 ** 52.  More are split down a tree instead.  Either way counts are
    those of independent draws, add up to ``target`` and don't depend on partitioning.  Only keys are shuffled.
    ``key`` must be unique; null keys are refused.
    """
    return counts_by_draws(df, key, target, seed) if target <= DRAWN else counts_by_tree(df, key, target, seed, leaf_rows)


def counts_by_draws(df: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    """``bootstrap_counts`` in time that grows with rows and draws: equal places are counted, then met by the rows."""
    keys = staged(df.select(F.col(key).alias("_key")), "keys")
    n = _rows_with_keys(keys, key)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|draw|"), F.col("id").cast("string")).cast("binary")), 1, 13)
    place = F.floor(F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**52) * F.lit(n)).alias("_place")
    draws = df.sparkSession.range(target).select(place).groupBy("_place").agg(F.count("*").alias("_times"))
    times = staged(dense_index(keys, "_key", "_place", n).join(draws, "_place").select(F.col("_key").alias(key), "_times"), "times")
    release(keys)
    return times


def _rows_with_keys(keys: DataFrame, key: str) -> int:
    """Number of rows, all of which must have a _key."""
    n, nulls = keys.agg(F.count("*"), F.count_if(F.col("_key").isNull())).first()
    if nulls:
        raise ValueError(f"{nulls} rows have no {key}")
    return n


def counts_by_tree(df: DataFrame, key: str, target: int, seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``bootstrap_counts`` in time that grows with rows only: no draw is made.

    Rows are the leaves of a tree of the digits of their hash; at each node the draws are split among the children by
    binomials that depend on seed and node only, in proportion to the rows below.  Within the last node rows take their
    counts one after the other, in order of their hash, so a task holds a few numbers whatever the size of a node.
    """
    spark = df.sparkSession
    hashed = staged(df.select(F.col(key).alias("_key"), F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")).alias("_h")), "hashed")
    n = _rows_with_keys(hashed, key)
    digits = 0
    while leaf_rows * 16**digits < n:
        digits += 1
    prefix = F.substring("_h", 1, digits) if digits else F.lit("")
    nodes = hashed.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_rows"))
    top = nodes.groupBy(F.substring("_prefix", 1, TOP_DIGITS).alias("_top")).agg(F.sum("_rows").alias("_rows")).orderBy("_top").collect()
    draws = split_draws(target, [r["_rows"] for r in top], f"{seed}|")
    tops = spark.createDataFrame([(r["_top"], d) for r, d in zip(top, draws, strict=True)], "_top string, _draws long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                below = row["_below"]
                rows = [r["_rows"] for r in below]
                yield pa.RecordBatch.from_pydict({"_prefix": [r["_prefix"] for r in below], "_rows": rows, "_draws": split_draws(row["_draws"], rows, f"{seed}|{row['_top']}")})

    # 16 ** (digits - TOP_DIGITS) nodes below each top at most
    below = nodes.groupBy(F.substring("_prefix", 1, TOP_DIGITS).alias("_top")).agg(F.array_sort(F.collect_list(F.struct("_prefix", "_rows"))).alias("_below"))
    leaves = below.join(tops, "_top").mapInArrow(split, "_prefix string, _rows long, _draws long")
    nothing = F.lit(None).cast("long")
    marked = leaves.select("_prefix", F.lit("").alias("_h"), F.lit(None).cast(hashed.schema["_key"].dataType).alias("_key"), "_rows", "_draws")
    # the head of a leaf comes before its rows
    streams = marked.unionByName(hashed.select(prefix.alias("_prefix"), "_h", "_key", nothing.alias("_rows"), nothing.alias("_draws")))
    dealt = streams.repartition("_prefix").sortWithinPartitions("_prefix", "_h", "_key")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = left = 0
        for batch in batches:
            times = []
            for h, head_rows, head_draws in zip(*(batch.column(c).to_pylist() for c in ("_h", "_rows", "_draws")), strict=True):
                if h == "":
                    rows, left = head_rows, head_draws
                    times.append(0)
                    continue
                k = draws_of_one(left, rows, h, seed)
                rows, left = rows - 1, left - k
                times.append(k)
            drawn = pa.array(times, pa.int64())
            keep = pa.array(np.array(times) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("_key").filter(keep), drawn.filter(keep)], names=["_key", "_times"])

    counts = dealt.mapInArrow(take, f"_key {hashed.schema['_key'].dataType.simpleString()}, _times long")
    return staged(counts.withColumnRenamed("_key", key), "times")


def _generator(name: str) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int.from_bytes(sha256(name.encode()).digest()[:16], "little")))


def split_draws(draws: int, rows: Sequence[int], name: str) -> list[int]:
    """Draws with replacement from all ``rows`` together, as a number for each group; a function of ``name``."""
    made, left, out = _generator(name), sum(rows), []
    for n in rows:
        k = draws if n == left else int(made.binomial(draws, n / left))
        out.append(k)
        draws, left = draws - k, left - n
    return out


def draws_of_one(draws: int, rows: int, h: str, seed: int) -> int:
    """How many of ``draws`` fall on the first of ``rows`` rows: a binomial number, found from its hash ``h``.

    The 60 bits after the 16 digits that order rows are compared with the sums of probabilities, 0 draws first.
    """
    if rows == 1 or not draws:
        return draws
    if draws > MANY * rows:
        return int(_generator(f"{seed}|{h}").binomial(draws, 1 / rows))
    u, p = int(h[16:31], 16) / 2**60, 1 / rows
    k, chance = 0, (1 - p) ** draws
    total = chance
    while u >= total and k < draws and chance > 0:
        chance *= (draws - k) / (k + 1) * (p / (1 - p))
        total += chance
        k += 1
    return k


def split_exact_count(df: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", F.concat(split_hash_value(seed, F.col(key)), F.lit("|"), F.col(key).cast("string")))
    border = smallest_border(hashed, "_h", target)
    return hashed.filter(F.lit(False) if border is None else F.col("_h") <= border).drop("_h")


def id_format(prefix: str, index: Column, target: int) -> Column:
    """prefix-000000001: as wide as the largest number, nine digits at least."""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(index.cast("string"), max(9, len(str(target))), "0"))


@dataclass(frozen=True)
class ScaleJob:
    table: str
    key: str
    id_column: str | None
    prefix: str


def scaled(df: DataFrame, job: ScaleJob, target: int, seed: int = 42) -> DataFrame:
    """``df`` resized to ``target`` rows, with new ids where the job has an id column (matched in any case)."""
    out = _copies(df, job.key, target, seed)
    have = {c.lower(): c for c in df.columns}
    name = have.get((job.id_column or "").lower())
    if name is None:
        return out.select(*df.columns)
    # numbered by key and copy, which no retry and no partitioning changes
    numbered = dense_index(out.withColumn("_row", F.concat_ws("|", F.col(job.key).cast("string"), "_each")), "_row", "_index", target)
    return numbered.withColumn(name, id_format(job.prefix, F.col("_index") + 1, target)).select(*df.columns)

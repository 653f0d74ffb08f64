"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of its source
(2 at most).  The expected copies are prefix-summed over the source in an order of its documents,
one random offset is added, and a document is emitted once for each integer boundary that its
step crosses.  The order is by size (equal ones by the MD5 of their ids), so that small and large documents are both taken in
proportion and the words taken stay within about one large document of the target.

As all documents of a source have the same expected copies, the prefix sum is a rank times that
number.  One source may hold a third of all rows, so ranks are taken in parts (see ``ranks``).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; together they get 150 %
of all words; none gets over twice its words, and what is over is shared again by weight.

Cases: null text has size 0; empty documents count as documents and take 0 words; repeated rows are
documents of their own; a source of no words has target 0; an empty table gives an empty result;
further columns of the input are not looked at (``mix`` carries them along, whatever their names); rows with
null ids are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .staging import staged
from .text import whole_row, word_count

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MOST_COPIES = 2


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source (null included): source, source_size, target.

    With sources ordered by limit / weight, the first k of which get their limit, the rest share
    (budget - limits of the k) by weight; the level that this gives is highest at the right k.
    The window runs over one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(w).cast("long") for w in WEIGHTS))
    weighed = totals.withColumn("weight", F.element_at(weights, (place % len(WEIGHTS) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    limit = MOST_COPIES * F.col("source_size")
    budget = F.sum("source_size").over(everything) * BUDGET_PERCENT / F.lit(100.0)
    left = budget - F.coalesce(F.sum(limit).over(earlier), F.lit(0))
    to_share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    levels = weighed.withColumn("level", left / to_share)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(limit.cast("double"), level * F.col("weight")).alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """A number of [0, 1) for each source that depends on nothing else, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def taken_copies(sizes: DataFrame, seed: int = 7) -> DataFrame:
    """``sizes`` (doc_id, source, size) with source_size, target and copies."""
    # null sources are a group of their own, and plain keys let one shuffle serve window and join
    named = sizes.select("doc_id", "source", "size", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"))
    targets = source_targets(sizes).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target")
    placed = ranked(named, ["_source"], ["size"], ["doc_id"]).join(targets, "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = random_offset(F.col("source"), seed)
    copies = F.floor((F.col("rank") + 1) * rate + offset) - F.floor(F.col("rank") * rate + offset)
    return placed.select("doc_id", "source", "size", "source_size", "target", F.least(copies.cast("long"), F.lit(MOST_COPIES).cast("long")).alias("copies"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: rows of ``docs`` (doc_id, text, source, ...), each as often as it is taken.

    Copies are decided on ids and sizes; texts are shuffled once, to meet their number of copies.
    """
    key = ("doc_id", "source", "size")
    sized = docs.select(whole_row(docs), "doc_id", "source", word_count(F.col("text")).alias("size"))
    # written, so that words are counted twice at most: here, and where texts meet their copies
    sizes = staged(sized.select(*key), "sizes")
    # rows that agree in id, source and size may take different numbers of copies; which gets which is the same
    copies = taken_copies(sizes, seed).groupBy(*(F.col(c).alias(f"its_{c}") for c in key)).agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    numbered = sized.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("size")))
    met = numbered.join(copies, F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & F.col("source").eqNullSafe(F.col("its_source")) & (F.col("size") == F.col("its_size")))
    times = F.element_at("copies", F.col("nth"))
    return met.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")).select("row.*")

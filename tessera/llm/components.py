"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of any comparable type -> (node, root), root the smallest node reachable.

    Distributed union-find by alternating stars: in the large step every node links its larger
    neighbours to its smallest one, in the small step its smaller neighbours and itself.  The
    links become one star per component after a number of rounds that grows with the logarithm of
    the component's size.  Each round is one job whose links are written to the shared folder; the driver sees counts only.
    Nodes without links are not in the result; a and b may be equal, and links may repeat.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = staged(edges, "links")
    if edges.isEmpty():
        return edges.toDF("node", "root")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        earlier, edges = edges, staged(small.filter("a <> b").distinct(), "links")
        release(earlier)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: every node but the root links to the root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

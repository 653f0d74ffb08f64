"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``most`` or fewer differing bits.  The bits are cut into m parts,
and part i gets a threshold t_i (-1: unused) with sum(t_i) = most - m + 1: two linked fingerprints
then differ by at most t_i within at least one part.  So it is enough to look up, for each
fingerprint and part, the fingerprints whose part is within t_i of its own, and verify those.

* Bits that are correlated over the corpus are grouped into one part, which leaves the other parts
  with independent, hence selective, bits.
* For each m, dynamic programming chooses the thresholds with the lowest estimated cost, made of
  probes and candidates.  Estimates come from all fingerprints: how many pairs agree on each part
  (counted), and how often each bit agrees.  They decide about speed only, never about results.
* Candidates are found by an equi-join of probes with the parts of all distinct fingerprints, and
  verified in the join's condition.  A pair is kept at the first part that finds it.

Work is done on distinct fingerprints: a group of copies, however large, is one row.  A
fingerprint has at most 2080 others within two bits, so links stay in proportion to the rows.

Cases: null and empty texts have fingerprint zero and link like any other; fewer than three words
are one shingle; repeated rows share a component; null ids are smaller than others only if alone
(min ignores null); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .staging import staged
from .text import as_bytes, slices, text_digest, whole_row

BITS = 64
SEED = 42
SHINGLE = 3
MOST_DIFFERING = 2
#: Cost of a probe in candidates: a probe is written, shuffled and sorted; a candidate is compared in place.
PROBE_COST = 4.0


def fingerprint(text: bytes) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: lower-cases A-Z, cuts at the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(len(words) - SHINGLE + 1, 1)
    last = ends[-n:] - 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, fp and the ``carried`` columns for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    more = rows.columns[2:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = pa.array([fingerprint(t) for t in as_bytes(batch, "text")], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, *(batch.column(c) for c in more)], names=["doc_id", "fp", *more])

    return rows.mapInArrow(each, ", ".join(["doc_id long, fp long", *(f"{c} {t}" for c, t in rows.dtypes[2:])]))


@dataclass
class Part:
    bits: list[int]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """All changes of at most ``threshold`` bits of the part, none first."""
        return [signed(sum(1 << b for b in some)) for k in range(self.threshold + 1) for some in combinations(self.bits, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.asarray(batch.column("fp"), "<i8")
            for i in range(0, len(x), 65536):
                bits = np.unpackbits(np.ascontiguousarray(x[i : i + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                sums += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*sums.ravel().tolist(), float(n)])], names=["cell", "value"])

    total = np.zeros(BITS * BITS + 1)
    for cell, value in fps.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        total[cell] = value
    return int(total[-1]), total[:-1].reshape(BITS, BITS)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near equal width; each grows from its most correlated bits."""
    left = set(range(BITS))
    parts = []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        if width >= len(left):
            part = sorted(left)
        else:
            order = sorted(left)
            sub = correlation[np.ix_(order, order)].copy()
            np.fill_diagonal(sub, -1)
            part = [order[j] for j in np.unravel_index(sub.argmax(), sub.shape)][:width]
            while len(part) < width:
                rest = sorted(left - set(part))
                part.append(rest[int(correlation[np.ix_(rest, part)].mean(axis=1).argmax())])
        left -= set(part)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a part, that add up to ``total`` at the lowest summed cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        longer: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for threshold, c in cost.items():
                if value + c < longer.get(spent + threshold, (inf, []))[0]:
                    longer[spent + threshold] = (value + c, [*chosen, threshold])
        best = longer
    return best[total]


def plan_parts(fps: DataFrame, most: int = MOST_DIFFERING) -> list[Part]:
    """Parts and thresholds for the distinct fingerprints ``fps`` (fp)."""
    n, both = bit_sums(fps)
    if n == 0:
        return []
    p = both.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    agree = np.clip(p**2 + (1 - p) ** 2, 0.5, 1.0)
    layouts = [group_bits(correlation, m) for m in range(1, most + 3)]
    values = F.array(*(F.struct(F.lit(i).alias("layout"), F.lit(j).alias("part"), F.col("fp").bitwiseAND(F.lit(Part(bits, 0).mask)).alias("value")) for i, parts in enumerate(layouts) for j, bits in enumerate(parts)))
    counted = fps.select(F.explode(values).alias("v")).groupBy("v").count()
    agreeing = {(r["layout"], r["part"]): r["pairs"] for r in counted.groupBy("v.layout", "v.part").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    choices = []
    for i, parts in enumerate(layouts):
        costs = []
        for j, bits in enumerate(parts):
            odds = ((1 - agree) / agree)[bits]
            within = [1.0, odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2]
            cost = {-1: 0.0}
            for t in range(min(most, 2) + 1):
                cost[t] = PROBE_COST * n * (1 + len(Part(bits, t).flips())) + agreeing[i, j] * sum(within[: t + 1])
            costs.append(cost)
        value, thresholds = allocate(costs, most - len(parts) + 1)
        choices.append((value, [Part(b, t) for b, t in zip(parts, thresholds, strict=True)]))
    return min(choices, key=lambda c: c[0])[1]


def near_pairs(fps: DataFrame, parts: list[Part], most: int = MOST_DIFFERING) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fps`` that differ in at most ``most`` bits."""
    used = [part for part in parts if part.threshold >= 0]
    probes = indexed = found = None
    for i, part in enumerate(used):
        value = F.col("fp").bitwiseAND(F.lit(part.mask))
        flips = F.array(*(F.lit(f).cast("long") for f in part.flips()))
        one = fps.select(F.col("fp").alias("a"), value.alias("own"), F.explode(flips).alias("flip"))
        one = one.select("a", F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        two = fps.select(F.col("fp").alias("b"), F.lit(i).alias("part"), value.alias("value"))
        probes, indexed = (one, two) if probes is None else (probes.union(one), indexed.union(two))
        earlier = [F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(q.mask))) > q.threshold for q in used[:i]]
        first = F.col("probes.part") == i
        for e in earlier:
            first = first & e
        found = first if found is None else found | first
    if probes is None:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    probes, indexed = probes.alias("probes"), indexed.alias("indexed")
    same = (F.col("probes.part") == F.col("indexed.part")) & (F.col("probes.value") == F.col("indexed.value"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return probes.join(indexed, same & near & found).select("a", "b")


def fingerprint_classes(fps: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """fp, root (a fingerprint, one a component), component_id for the distinct fingerprints of ``fps`` (doc_id, fp)."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = near_pairs(distinct.select("fp"), plan_parts(distinct.select("fp"), most), most)
    roots = connected_components(links)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return staged(rooted.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable)."""
    fps = staged(fingerprints(docs), "fingerprints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(fingerprint_classes(fps, most).drop("root"), "fp").select("doc_id", hexed, "component_id")


def keep_one_each(docs: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id (null only if it has no other), then of its smallest digest.

    Rows are told apart by id and digest of the text, so null and repeated ids are rows like any other; of rows
    that agree in both, one stays.  One shuffle of the texts.
    """
    fps = staged(fingerprints(docs, text_digest(F.col("text")).alias("digest")), "fingerprints")
    classes = fingerprint_classes(fps.select("doc_id", "fp"), most)
    firsts = fps.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "digest")).alias("first"))
    stay = firsts.join(classes, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("its_id"), F.col("first.digest").alias("its_digest"))
    marked = docs.select(whole_row(docs), "doc_id", text_digest(F.col("text")).alias("digest"))
    joined = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("digest"))
    return joined.withColumn("nth", one).filter("nth = 1").select("row.*")

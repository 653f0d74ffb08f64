"""Fuzzy deduplication of lines: MinHash over character shingles, native throughout.

1. Lines are cut, trimmed of white space (space, tab, carriage return, vertical tab, form feed) and
   lower-cased; equal ones have one 128-bit key and one first occurrence, and are one node from then on.
2. Signature: every shingle of ``SHINGLE`` UTF-16 units is hashed once; ``MINIMA`` minima of the hash
   XORed with fixed numbers are as many MinHash values.  Shingles are generated, hashed and reduced within
   one stage, ``RUN`` of them a row; only minima are shuffled, not texts.
3. Banding: ``BANDS`` groups of ``ROWS`` minima make a bucket each.  Lines of Jaccard similarity 0.8 meet
   in at least one bucket with a chance of 0.995, those of 0.85 with 0.999 (simulated; each minimum serves
   in one or two bands).
4. Verification is exact, on sets of the hashes (31 bits) of all shingles.  Texts are moved for lines that share a bucket
   only, told by a bitmap of fixed size and then by key.  Before any set is made, pairs are told apart by sketches (which of
   4,096 parts of the hashes a line's shingles fall on): a bit that one line alone has is a shingle that it alone has, so no
   similar pair is lost.  In each bucket all lines are compared with the first one, and in large ones with four more, which
   differ from bucket to bucket; components are made of the links found.  Where a bucket then holds several components, the
   lines outside its first line's component are compared with the bucket's lines of other components: sketches where they
   meet, sets of the few pairs that are left, each met in one of its buckets.  So a family of similar lines takes a few
   pairs a line, and no link between components is lost.  Sketches of near misses (lines of one bucket that are alike, but
   less than 0.8) are still compared for every two of them outside one component.
5. Components by distributed union-find; of each, the first line (smallest document, then place) is kept.

Cases: null text has one empty line; lines of white space only are never removed; shorter lines than a shingle are one
shingle; rows that share an id are versions of one document (equal places are one place); a null id is the smallest;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import release, staged

SHINGLE = 8
#: Shingles that are hashed in one row.
RUN = 4
MINIMA, BANDS, ROWS = 32, 12, 4
#: Least Jaccard similarity, as a fraction.
SIMILAR = (4, 5)
#: Numbers of 64 bits in a line's sketch.
SKETCH = 64
#: Lines of a large bucket, and its leaders besides the first.
LARGE, LEADERS = 16, 4

#: Fixed by their seed: the numbers that make many hash functions of one.
_rng = random.Random(20)
XORS = [_rng.getrandbits(31) for _ in range(MINIMA)]
#: Minima of each band: neighbours first, then those a quarter of all apart.
BAND_ROWS = ([[ROWS * b + r for r in range(ROWS)] for b in range(MINIMA // ROWS)] + [[b + MINIMA // ROWS * r for r in range(ROWS)] for b in range(MINIMA // ROWS)])[:BANDS]
#: Bits of the bitmap of keys that goes to all tasks (8 MB), and those of one of its rows, as Spark makes them.
SEEN_BITS, PART_BITS = 1 << 26, 15
UNIT = 2  # bytes of a UTF-16 unit
WHITE = " \t\r\x0b\x0c"
NO_ID = -(1 << 63)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line as compared, for every line of ``docs`` (doc_id, text)."""
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return cut.select("doc_id", "line_no", F.lower(F.trim("line", F.lit(WHITE))).alias("line"))


def _shingle_at(code: Column, i: Column) -> Column:
    return F.substring(code, i * UNIT + 1, F.lit(SHINGLE * UNIT))


def _last(code: Column) -> Column:
    """Where the last shingle starts."""
    return F.greatest((F.octet_length(code) / UNIT).cast("int") - SHINGLE, F.lit(0))


def _hashed(lines: DataFrame) -> DataFrame:
    """k1, k2 and the hashes h0, h1, ... (31 bits) of ``RUN`` shingles in a row, for each of ``lines`` (k1, k2, line)."""
    coded = lines.select("k1", "k2", F.encode("line", "UTF-16BE").alias("code")).withColumn("last", _last(F.col("code")))
    runs = coded.select("k1", "k2", "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(RUN))).alias("i"))
    # a run's end repeats the last shingle
    hashes = [F.xxhash64(_shingle_at(F.col("code"), F.least(F.col("i") + j, F.col("last")))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(f"h{j}") for j in range(RUN)]
    return runs.select("k1", "k2", *hashes)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """k1, k2, shingles: distinct hashes of the shingles of each of ``texts`` (k1, k2, line; a row a line)."""
    hashes = F.array(*(F.col(f"h{j}") for j in range(RUN)))
    return _hashed(texts).groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list(hashes))).alias("shingles"))


def sketches(texts: DataFrame) -> DataFrame:
    """k1, k2, most, s0 to s63 for each of ``texts`` (k1, k2, line; a row a line): which of 4,096 parts of the hashes its
    shingles fall on, and the most shingles that it may have."""
    places = [(F.shiftright(F.col(f"h{j}"), 6).bitwiseAND(F.lit(SKETCH - 1)), F.expr(f"shiftleft(1L, h{j} & 63)")) for j in range(RUN)]
    cut = _hashed(texts).select("k1", "k2", *(c.alias(f"{name}{j}") for j, place in enumerate(places) for name, c in zip(("word", "bit"), place, strict=True)))
    words = []
    for i in range(SKETCH):
        bits = [F.when(F.col(f"word{j}") == i, F.col(f"bit{j}")).otherwise(F.lit(0).cast("long")) for j in range(RUN)]
        words.append(F.bit_or(functools.reduce(Column.bitwiseOR, bits)).alias(f"s{i}"))
    return cut.groupBy("k1", "k2").agg((F.count("*") * RUN).alias("most"), *words)


def _may_be_similar() -> Column:
    """Whether two sketches (columns of ``sketches``, prefixed a_ and b_) can be those of similar lines: false for no similar ones.

    Each bit that one of them alone has stands for a shingle at least that one of them alone has, and similar lines have
    (whole - part) / (whole + part) of their shingles in this way at most.
    """
    part, whole = SIMILAR
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(SKETCH)])
    return differ * (whole + part) <= (F.col("a_most") + F.col("b_most")) * (whole - part)


def buckets(keyed: DataFrame) -> DataFrame:
    """k1, bucket: the bucket of each band for each distinct line of ``keyed`` (k1, k2, line).

    Equal lines have equal minima, so they are reduced to one row in the same step.
    """
    # 31 bits are enough for a minimum, as several of them make a bucket
    minima = [F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(x)) for j in range(RUN)))).alias(f"m{i}") for i, x in enumerate(XORS)]
    smallest = _hashed(keyed).groupBy("k1", "k2").agg(*minima)
    bands = [F.xxhash64(F.lit(b), *(F.col(f"m{r}") for r in rows)) for b, rows in enumerate(BAND_ROWS)]
    return smallest.select("k1", F.explode(F.array(*bands)).alias("bucket"))


def _bit(k1: Column) -> tuple[Column, Column]:
    """The part of a bitmap of ``SEEN_BITS`` bits that a key falls on, and its bit there."""
    place = F.pmod(k1, F.lit(SEEN_BITS))
    return F.shiftright(place, PART_BITS).cast("int"), place.bitwiseAND(F.lit((1 << PART_BITS) - 1))


def likely(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose k1 may be among ``keys`` (k1), and few others: none that is among them is lost.

    A bitmap of a fixed size goes to all tasks, so that lines that no other is like are left out before they are moved.
    """
    part, bit = _bit(F.col("k1"))
    bitmap = keys.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    part, bit = _bit(F.col("k1"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = keyed.withColumn("part", part).join(F.broadcast(bitmap), "part")
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (bit.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return found.filter(byte.bitwiseAND(mask) != 0).drop("part", "bits")


def _side(table: DataFrame, p: str) -> DataFrame:
    """``table`` with its columns named for one line of a pair: k1 and k2 are a1 and a2, others a_..."""
    return table.select(*(F.col(c).alias(p + c[1:] if c in ("k1", "k2") else f"{p}_{c}") for c in table.columns))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), structs of both keys, of the ``pairs`` (a1, a2, b1, b2) whose exact Jaccard similarity is high enough.

    ``texts``: k1, k2, line.  Sets are made of the lines in ``pairs`` only.
    """
    ends = pairs.select("a1", "a2").union(pairs.select("b1", "b2")).toDF("k1", "k2").distinct()
    made = staged(shingle_sets(texts.join(ends, ["k1", "k2"], "left_semi")), "sets")
    met = pairs.join(_side(made, "a"), ["a1", "a2"]).join(_side(made, "b"), ["b1", "b2"])
    part, whole = SIMILAR
    n = [F.size(f"{p}_shingles") for p in ("a", "b")]
    # common / (a + b - common) >= part / whole, with one mention of what is common
    alike = met.filter((F.least(*n) * whole >= F.greatest(*n) * part) & (F.size(F.array_intersect("a_shingles", "b_shingles")) * (part + whole) >= (n[0] + n[1]) * part))
    node = [F.struct(F.col(f"{p}1").alias("k1"), F.col(f"{p}2").alias("k2")).alias(p) for p in ("a", "b")]
    out = staged(alike.select(*node), "alike")
    release(made)
    return out


def links(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b), structs (k1, k2): enough pairs of similar lines to connect all that are similar.

    ``keyed``: doc_id, line_no, line, k1, k2 of all lines; ``firsts``: k1, k2 and the first place (doc_id, line_no)
    of distinct ones.  Buckets hold first keys only; where two lines agree in it, both are compared.
    """
    met = buckets(keyed)
    groups = met.groupBy("bucket").agg(F.min("k1").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("bucket", "leader")
    met = staged(met.join(groups, "bucket"), "buckets")
    # a null id is equal to itself here
    id = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    seen = firsts.join(met.select("k1").distinct(), "k1", "left_semi").select("k1", "k2", id, "line_no")
    # most lines are like no other; the rest are moved as they are, in half the bytes of their code
    near = likely(keyed, met.select("k1")).select("k1", "k2", id, "line_no", "line")
    texts = staged(near.join(seen, ["id", "line_no", "k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", "line"), "texts")
    drawn = staged(sketches(texts), "sketches")

    # the smallest key leads a family's buckets in most bands, so a large one has leaders of its own besides
    own = [F.min_by("k1", F.xxhash64(F.lit(i), "bucket", "k1")) for i in range(LEADERS)]
    large = met.groupBy("bucket").agg(F.count("*").alias("n"), F.array(*own).alias("leaders")).filter(F.col("n") >= LARGE).select("bucket", "leaders")
    led = met.select("k1", "leader").union(met.join(large, "bucket").select("k1", F.explode("leaders").alias("leader"))).filter("k1 <> leader")
    to_leader = led.select(F.least("k1", "leader").alias("a1"), F.greatest("k1", "leader").alias("b1")).distinct()
    same_key = drawn.select(F.col("k1").alias("a1"), F.col("k1").alias("b1")).groupBy("a1", "b1").count().filter("count > 1").drop("count")
    first = to_leader.union(same_key).join(_side(drawn, "a"), "a1").join(_side(drawn, "b"), "b1").filter(_may_be_similar())
    first = staged(first.select("a1", "a2", "b1", "b2"), "first")
    close = _similar(first, texts)

    roots = connected_components(close).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root")
    rooted = drawn.select("k1", "k2").join(roots, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("root", F.struct("k1", "k2")).alias("root"))
    member = staged(met.join(rooted, "k1"), "members")
    # leaders have met all others of their bucket
    led = F.col("k1") == F.col("leader")
    groups = member.groupBy("bucket").agg(F.min(F.when(~led, F.col("root"))).alias("low"), F.max(F.when(~led, F.col("root"))).alias("high"), F.min(F.when(led, F.col("root"))).alias("main"))
    mixed = member.filter(~led).join(groups.filter("low <> high").select("bucket", "main"), "bucket").select("bucket", "main", "k1", "k2", "root")
    mixed = staged(mixed.join(mixed.groupBy("k1", "k2").agg(F.collect_list("bucket").alias("buckets")).join(drawn, ["k1", "k2"]), ["k1", "k2"]), "mixed")
    outside = _side(mixed.filter("root <> main").drop("main"), "a").withColumnRenamed("a_bucket", "bucket")
    other = _side(mixed, "b").withColumnRenamed("b_bucket", "bucket")
    apart = (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_main")) | (F.col("a1") < F.col("b1")))
    # sketches part near misses where they meet, so that few pairs are made of them, each in one of its buckets
    once = F.array_min(F.array_intersect("a_buckets", "b_buckets")) == outside["bucket"]
    rest = outside.join(other, (outside["bucket"] == other["bucket"]) & apart & _may_be_similar() & once)
    # one order of both lines, whichever of them was outside
    in_order = [F.when(F.col("a1") < F.col("b1"), F.col(f"{p}{i}")).otherwise(F.col(f"{q}{i}")).alias(f"{p}{i}") for p, q in (("a", "b"), ("b", "a")) for i in (1, 2)]
    rest = rest.select(*in_order).distinct().join(first.select(*in_order), ["a1", "a2", "b1", "b2"], "left_anti")
    rest = staged(rest, "rest")
    release(met, member, mixed, drawn, first)
    more = _similar(rest, texts)
    found = staged(close.union(more), "found")
    release(texts, rest, close, more)
    return found


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """For every line of ``docs`` (doc_id, text): doc_id, line_no, first_doc_id and first_line_no of
    its component, and kept (blank lines are always kept and are their own component)."""
    keyed = lines(docs).select("doc_id", "line_no", "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("other"), "line").alias("k2"))
    visible = keyed.filter("line <> ''")
    keys = staged(keyed.select("doc_id", "line_no", "k1", "k2", (F.col("line") == "").alias("blank")), "keys")
    firsts = keys.filter("NOT blank").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    firsts = staged(firsts.select("k1", "k2", "first.doc_id", "first.line_no"), "firsts")
    found = links(visible, firsts)
    roots = connected_components(found).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root")
    linked = staged(firsts.join(roots, ["k1", "k2"]), "linked")
    earliest = linked.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    moved = linked.join(earliest, "root").select("k1", "k2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))
    # written, so that the join below shuffles both sides plainly and can split a line that very many documents have
    single = firsts.join(linked, ["k1", "k2"], "left_anti").select("k1", "k2", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"))
    placed = staged(moved.union(single), "placed")
    release(found, linked, firsts)
    shown = keys.filter("NOT blank").join(placed, ["k1", "k2"]).select("doc_id", "line_no", "first_doc_id", "first_line_no")
    blank = keys.filter("blank").select("doc_id", "line_no", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"))
    same = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    return shown.union(blank).withColumn("kept", same)


def kept_text(docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines that are not kept."""
    decided = deduplicate_lines(docs).filter("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(decided.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    keep = F.filter(split, lambda line, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return joined.select("doc_id", F.array_join(keep, "\n").alias("text"))

"""A Merkle manifest of a dataset: digests of rows, of row groups and of the whole, and proofs for each row.

Each row is a leaf.  The leaves of a group (one language, say) ascend by id under a subroot, and the subroots, in order of
their groups, stand under the root.  A parent is the digest of its two children; a last child without a partner has a
parent of its own.

Trees are kept as blocks: aligned subtrees of ``BLOCK_HEIGHT`` levels above their leaves, each one row.  The roots of one
tier of blocks are the leaves of the next, until a group has one block, so that a tier is one job and tiers grow with the
logarithm of the largest group.  Within a block nodes lie in van Emde Boas order: the upper half of the levels first,
then the subtrees below it one by one, each ordered the same way.  A node's place is arithmetic on its level and index; a
path from leaf to root touches few neighbourhoods of the array however large cache lines are.  Blocks are built and
siblings read by these places.  Proofs come down the tiers: what lies above a block is found once for the block.

Leaves are dealt by ranges of (group, id, leaf), so a group of a third of all rows is many tasks; places are counts of
earlier tasks plus a number within the task.  No task holds more than one block at a time beyond a batch of rows.

Cases: null columns have a digest of their own (``-``); a null group comes first; null ids come first in a group, equal
ids are ordered by leaf; repeated rows are leaves each (which of equal leaves has which place makes no difference); an
empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import release, staged

#: Levels of a block above its leaves: 256 leaves, 16 KB of digests.
BLOCK_HEIGHT = 8
DIGEST = 32
#: A step of a path: whether the sibling is to the right (1), to the left (2) or missing (0), and the sibling.
STEP = 1 + DIGEST


@lru_cache
def places(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a complete tree in van Emde Boas order: by depth from the root, then by index."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    top, low = places(upper), places(levels - upper)
    start, size = 2**upper - 1, 2 ** (levels - upper) - 1
    below = []
    for depth, at in enumerate(low):
        index = np.arange(2 ** (upper + depth))
        below.append(start + (index >> depth) * size + at[index & (2**depth - 1)])
    return (*top, *below)


def parent(children: Sequence[bytes]) -> bytes:
    """Digest of the children's digests, as lower-case hex text one after the other."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


@dataclass(frozen=True)
class Block:
    """An aligned subtree over ``n`` leaves, ``height`` levels high, its digests in van Emde Boas order."""

    height: int
    n: int
    store: bytes | bytearray

    @staticmethod
    def built(leaves: Sequence[bytes], height: int) -> Block:
        out = Block(height, len(leaves), bytearray((2 ** (height + 1) - 1) * DIGEST))
        for i, leaf in enumerate(leaves):
            out._put(0, i, leaf)
        for level in range(height):
            count = out.count(level)
            for i in range(out.count(level + 1)):
                out._put(level + 1, i, parent([out.node(level, j) for j in range(2 * i, min(2 * i + 2, count))]))
        return Block(height, out.n, bytes(out.store))

    def count(self, level: int) -> int:
        """Nodes of a level, from the leaves up."""
        return -(-self.n >> level)

    def _at(self, level: int, index: int) -> int:
        return int(places(self.height + 1)[self.height - level][index]) * DIGEST

    def _put(self, level: int, index: int, digest: bytes) -> None:
        at = self._at(level, index)
        self.store[at : at + DIGEST] = digest

    def node(self, level: int, index: int) -> bytes:
        at = self._at(level, index)
        return bytes(self.store[at : at + DIGEST])

    @property
    def root(self) -> bytes:
        return self.node(self.height, 0)

    def path(self, leaf: int) -> bytes:
        """Steps from a leaf to the root of the block."""
        steps = []
        for level in range(self.height):
            index = leaf >> level
            if index ^ 1 < self.count(level):
                steps.append((b"\x02" if index & 1 else b"\x01") + self.node(level, index ^ 1))
            else:
                steps.append(bytes(STEP))
        return b"".join(steps)


def siblings(path: bytes) -> str:
    """The siblings of a path as hex text."""
    return "".join(path[at + 1 : at + STEP].hex() for at in range(0, len(path), STEP) if path[at])


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for at in range(0, len(path), STEP):
        side, other = path[at], path[at + 1 : at + STEP]
        digest = parent([digest, other] if side == 1 else [other, digest] if side else [digest])
    return digest


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """Groups as texts that are never null and in order: null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group.cast("string")))


def placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with ``tree``) with ``place`` (from 0, by ``order``) within their tree and the tree's size ``n``."""
    columns = leaves.columns
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column("tree").to_pylist()
            nth = []
            for tree in trees:
                seen = seen + 1 if tree == last else 0
                last = tree
                nth.append(seen)
            added = [pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "part", "nth"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    numbered = staged(ranged.mapInArrow(number, schema + ", part long, nth long"), "numbered")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    # one row a task and tree, so the windows are small however many leaves a tree has
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(starts, ["tree", "part"]).select(*columns, (F.col("start") + F.col("nth")).alias("place"), "n")


def _blocks(nodes: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Blocks of one tier: tree, block, n (nodes of the tree in this tier), members, store, height, root.

    ``nodes``: tree, place, digest, n and the ``extra`` columns, which stay with the members.
    """
    width = 1 << BLOCK_HEIGHT
    grouped = nodes.groupBy("tree", F.shiftright("place", BLOCK_HEIGHT).alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", *extra))).alias("members")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, members in zip(batch.column("n").to_pylist(), batch.column("members"), strict=True):
                leaves = [bytes.fromhex(d) for d in members.values.field("digest").to_pylist()]
                # a tree's only block is as high as it needs to be, others are whole
                made.append(Block.built(leaves, BLOCK_HEIGHT if n > width else (n - 1).bit_length()))
            added = [pa.array([b.store for b in made], pa.binary()), pa.array([b.height for b in made], pa.int32()), pa.array([b.root.hex() for b in made])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "store", "height", "root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return staged(grouped.mapInArrow(build, schema + ", store binary, height int, root string"), "blocks")


def _tiers(nodes: DataFrame, extra: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All tiers of blocks from the leaves up, and (tree, tier, root) of every tree."""
    width = 1 << BLOCK_HEIGHT
    tiers: list[DataFrame] = []
    roots = None
    while True:
        blocks = _blocks(nodes, extra if not tiers else ())
        tops = blocks.filter(F.col("n") <= width).select("tree", F.lit(len(tiers)).alias("tier"), "root")
        roots = tops if roots is None else roots.union(tops)
        tiers.append(blocks)
        rest = blocks.filter(F.col("n") > width)
        if rest.isEmpty():
            return tiers, roots
        nodes = rest.select("tree", F.col("block").alias("place"), F.col("root").alias("digest"), F.ceil(F.col("n") / F.lit(float(width))).alias("n"))


def _descended(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, place, path and the other columns of ``above``) for each member of the blocks of one tier.

    ``above``: tree, block, path (from the block's root up) and columns that are the same for all members.
    """
    kept = [c for c in above.columns if c not in ("tree", "block", "path")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("count").to_pylist()
            stores, heights, paths = (batch.column(c).to_pylist() for c in ("store", "height", "path"))
            out = [Block(h, n, s).path(i) + p for n, s, h, p in zip(counts, stores, heights, paths, strict=True) for i in range(n)]
            of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            first = np.repeat(np.array(batch.column("block")) << BLOCK_HEIGHT, counts)
            place = first + np.concatenate([np.arange(n) for n in counts]) if counts else first
            columns = [batch.column("tree").take(of), pa.array(place, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(of) for c in kept)], names=["tree", "place", "path", *kept])

    joined = blocks.select("tree", "block", F.size("members").alias("count"), "store", "height").join(above, ["tree", "block"])
    return joined.mapInArrow(walk, "tree string, place long, path binary" + "".join(f", {c} string" for c in kept))


def _above_blocks(tiers: list[DataFrame], roots: DataFrame, over: DataFrame) -> DataFrame:
    """``over`` (tree, path above the tree's root, more columns) brought down to the blocks of the lowest tier."""
    above = None
    for tier in reversed(range(len(tiers))):
        tops = over.join(roots.filter(F.col("tier") == tier).select("tree"), "tree").withColumn("block", F.lit(0).cast("long"))
        above = tops if above is None else tops.unionByName(_descended(tiers[tier + 1], above).withColumnRenamed("place", "block"))
    return above


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of all rows of ``leaves``: doc_id, group (text or null), leaf (hex digest), offered (a digest to check, or null).

    Returns doc_id, leaf, subroot, root, proof_sha256 (digest of the siblings from leaf to root), folded_root (the root that
    ``offered``, or else the leaf, gives with these siblings) and verified (it is the root).
    """
    keyed = leaves.select(group_key(F.col("group")).alias("tree"), "doc_id", F.col("leaf").alias("digest"), "offered", F.monotonically_increasing_id().alias("row"))
    keyed = staged(keyed, "leaves")
    # equal rows are told apart by a number, so that ranges can part them too
    rows = placed(keyed, ["doc_id", "digest", "row"]).drop("row")
    tiers, subroots = _tiers(rows, ["doc_id", "offered"])
    groups = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"])
    groups = staged(groups, "groups")
    top_tiers, top_roots = _tiers(groups.select("tree", "place", "digest", "n"))
    whole = top_roots.select("tree", F.lit(b"").alias("path"), "root")
    steps = _descended(top_tiers[0], _above_blocks(top_tiers, top_roots, whole))
    over = groups.join(steps, ["tree", "place"]).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    above = _above_blocks(tiers, subroots, staged(over, "over"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                members, up = row["members"].values, row["path"].as_py()
                leaves, offered = (members.field(c).to_pylist() for c in ("digest", "offered"))
                subroot, root = row["subroot"].as_py(), row["root"].as_py()
                block = Block(row["height"].as_py(), len(leaves), row["store"].as_py())
                shared, known = siblings(up), {}
                proofs, roots = [], []
                for k, (leaf, other) in enumerate(zip(leaves, offered, strict=True)):
                    path = block.path(k)
                    proofs.append(sha256((siblings(path) + shared).encode()).hexdigest())
                    mine = folded(bytes.fromhex(leaf if other is None else other), path)
                    if mine not in known:  # the same for all members that agree at the block's root
                        known[mine] = folded(mine, up).hex()
                    roots.append(known[mine])
                n = len(leaves)
                arrays = [members.field("doc_id"), pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
                yield pa.RecordBatch.from_arrays(arrays, names=PROOF_COLUMNS)

    blocks = tiers[0].select("tree", "block", "members", "store", "height").join(above, ["tree", "block"])
    out = staged(blocks.select("members", "store", "height", "path", "subroot", "root").mapInArrow(prove, PROOFS), "proofs")
    release(keyed, *tiers, *top_tiers, groups)
    return out


PROOF_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def documents_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """``manifest`` of documents (doc_id, source, lang, n_chars, text) by language.

    Rows that are ``tampered`` offer the digest of their row with one character more in n_chars.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    changed = [more if i == 3 else c for i, c in enumerate(columns)]
    return manifest(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("lang").alias("group"),
            row_digest(columns).alias("leaf"),
            F.when(tampered, row_digest(changed)).alias("offered"),
        )
    )

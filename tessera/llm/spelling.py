"""Groups of spelling variants: words that are one letter apart, and the more frequent form that each stands for.

Words that differ by one inserted, deleted or replaced letter have letter-count vectors at an L1 distance of at most two
(of one, where a letter is added).  Vectors of each word length are dealt to the cells of a k-d tree.  A word visits the
cells of its own length within distance two of it and those of the next length within distance one; the other direction
is the mirror image.  In a cell a k-d tree over the members prunes by the bounding boxes of its nodes, what is left is
compared by distance, and the order of letters decides.

The cells come from a tree that is fitted on about ``SAMPLE_WORDS`` words.  They are a division of the work only: every word
is a member of the one cell that holds its vector, and boxes are exact, so the pairs found do not depend on the sample.
Members of a cell are held by its task; the words that visit stream past them.

Cases: a null text has no words; a null id counts as an empty string in the hash; repeated rows count again; words of any
length are compared whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged
from .text import LOWER, UPPER, slices

#: Words that the division into cells is fitted on, about (by a share of the values of their hash), or all if there are fewer.
SAMPLE_WORDS = 65_536

#: Words that a cell is meant to hold, about.
CELL_WORDS = 8_192

#: Members of a leaf of a cell's own tree.
LEAF_WORDS = 32

#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000

#: Letters that words are made of: a-z and U+00C0 to U+00FF.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
_DIMENSION = np.zeros(0x100, np.int64)
_DIMENSION[LETTERS] = np.arange(len(LETTERS))
_LOWERED = str.maketrans(UPPER, LOWER)


def count_words(docs: DataFrame, least_length: int, least_count: int, typo_rate: int) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with enough letters and occurrences, written.

    A run whose CRC-32 with its document's id is divisible by ``typo_rate`` loses the letter that the hash points at.
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")  # shorter runs only get shorter

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
                for doc_id, text in zip(ids, texts, strict=True):
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in Counter(m[0] for m in runs.finditer(text or "")).items():
                        run = run.lower() if run.isascii() else run.translate(_LOWERED)
                        h = zlib.crc32(run.encode(), start)
                        if h % typo_rate == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_length:
                                continue
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counts = rows.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counts.filter(F.col("n") >= least_count), "words")


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts of words, one row a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _DIMENSION[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    owners = np.repeat(np.arange(len(words)), lengths)
    cells = np.bincount(owners * len(LETTERS) + letters, minlength=len(words) * len(LETTERS))
    return cells.reshape(len(words), len(LETTERS)).astype(np.int32)


def codes(words: list[str], length: int) -> np.ndarray:
    """Letters of words that all have ``length`` of them, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


@dataclass
class Node:
    """A node of a k-d tree: a box, and either a split (left: at most ``at`` in ``dimension``) or a leaf."""

    low: np.ndarray
    high: np.ndarray
    members: np.ndarray
    leaf: int = -1
    dimension: int = -1
    at: int = 0
    children: list[Node] = field(default_factory=list)

    def distance(self, points: np.ndarray) -> np.ndarray:
        """L1 distance of points to the box."""
        return (np.maximum(self.low - points, 0) + np.maximum(points - self.high, 0)).sum(1)


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The dimension of the largest variance and a value that leaves points on both sides; None for equal points."""
    spread = points.max(0) - points.min(0)
    if not spread.any():
        return None
    d = int(np.argmax(np.where(spread > 0, points.var(0), -1.0)))
    return d, int(min(np.median(points[:, d]), points[:, d].max() - 1))


def tight_tree(points: np.ndarray, members: np.ndarray | None = None) -> Node:
    """A tree over the rows of ``points``, each node with the bounding box of its members."""
    members = np.arange(len(points)) if members is None else members
    mine = points[members]
    node = Node(mine.min(0), mine.max(0), members)
    split = _split(mine) if len(members) > LEAF_WORDS else None
    if split:
        left = mine[:, split[0]] <= split[1]
        node.children = [tight_tree(points, members[side]) for side in (left, ~left)]
    return node


#: A bound beyond any letter count.
FAR = 2**30


def cell_tree(points: np.ndarray, cell_points: int) -> Node:
    """A tree whose leaves, numbered from 0, part all of space; each holds about ``cell_points`` of the ``points``."""
    k = points.shape[1]
    root = Node(np.full(k, -FAR), np.full(k, FAR), np.arange(len(points)))
    todo, leaves = [root], 0
    while todo:
        node = todo.pop()
        mine = points[node.members]
        split = _split(mine) if len(mine) > cell_points else None
        if split is None:
            node.leaf, leaves = leaves, leaves + 1
        else:
            node.dimension, node.at = split
            left = mine[:, node.dimension] <= node.at
            for side, bounds in ((left, node.high), (~left, node.low)):
                low, high = node.low.copy(), node.high.copy()
                (high if bounds is node.high else low)[node.dimension] = node.at if bounds is node.high else node.at + 1
                node.children.append(Node(low, high, node.members[side]))
            todo += node.children
        node.members = node.members[:0]
    return root


def near_leaves(root: Node, points: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """The leaves whose box is within ``radius`` of points, with the rows of these points."""
    todo = [(root, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        rows = rows[node.distance(points[rows]) <= radius]
        if not len(rows):
            continue
        if node.children:
            todo += [(child, rows) for child in node.children]
        else:
            yield node, rows


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters of the same length differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_added(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of ``long`` are those of ``short`` with one letter more: equal beginnings and ends meet."""
    begin = np.cumprod(short == long[:, :-1], 1).sum(1)
    end = np.cumprod((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return begin + end >= short.shape[1]


class Cell:
    """The members of a cell, all of one length, and the words near them."""

    def __init__(self, words: list[str], counts: list[int], length: int):
        self.words, self.counts, self.length = words, counts, length
        points, self.codes = vectors(words), codes(words, length)
        # letters that no member has add to every distance alike
        self.used = points.any(0)
        self.points = points[:, self.used]
        self.tree = tight_tree(self.points)

    def near(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``words``, members): all pairs one letter apart.  ``length`` is the members' or one less."""
        radius, check = (2, one_replaced) if length == self.length else (1, one_added)
        points, letters = vectors(words), codes(words, length)
        beside = points[:, ~self.used].sum(1)
        points = points[:, self.used]
        rows, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.tree, np.flatnonzero(beside <= radius))]
        while todo:
            node, own = todo.pop()
            own = own[node.distance(points[own]) + beside[own] <= radius]
            if not len(own):
                continue
            if node.children:
                todo += [(child, own) for child in node.children]
                continue
            apart = np.abs(points[own, None, :] - self.points[None, node.members, :]).sum(2) + beside[own, None]
            q, m = np.nonzero(apart <= radius)
            q, m = own[q], node.members[m]
            right = check(letters[q], self.codes[m])
            rows.append(q[right])
            members.append(m[right])
        return np.concatenate(rows), np.concatenate(members)


def fitted_cells(words: DataFrame) -> dict[int, Node]:
    """A tree of cells for each length among a bounded sample of the words; other lengths are one cell each."""
    total = words.count()
    # a share of all hash values, so no task sends more than its words' share of the sample
    share = F.xxhash64("word").bitwiseAND(F.lit(0x7FFFFFFF)) < int(SAMPLE_WORDS / max(total, SAMPLE_WORDS) * 2**31)
    sample = words.select("word").filter(share)
    by_length: dict[int, list[str]] = {}
    for (word,) in sample.collect():
        by_length.setdefault(len(word), []).append(word)
    cell_points = max(32, CELL_WORDS * min(total, SAMPLE_WORDS) // max(total, 1))
    return {length: cell_tree(vectors(sorted(found)), cell_points) for length, found in by_length.items()}


ROUTED = "length int, cell int, kind int, word string, n long"
PAIRS = "word string, n long, near string, near_n long"
#: Words that visit a cell at a time.
VISITORS = 2_000


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words of ``words`` (word, n) that are one letter apart, written."""
    trees = words.sparkSession.sparkContext.broadcast(fitted_cells(words))  # a bounded sample's tree
    whole = Node(np.full(len(LETTERS), -FAR), np.full(len(LETTERS), FAR), np.zeros(0, np.int64), 0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, word in enumerate(found):
                by_length.setdefault(len(word), []).append(i)
            for length, rows in by_length.items():
                points = vectors([found[i] for i in rows])
                # members (kind 0), words of the same length (1), and of one letter less (2)
                for kind, their, radius in ((0, length, 0), (1, length, 2), (2, length + 1, 1)):
                    for leaf, own in near_leaves(trees.value.get(their, whole), points, radius):
                        sent = [rows[k] for k in own]
                        columns = [pa.array([x] * len(sent), pa.int32()) for x in (their, leaf.leaf, kind)]
                        columns += [pa.array([found[i] for i in sent], pa.string()), pa.array([counts[i] for i in sent], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["length", "cell", "kind", "word", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, members, counts = None, None, [], []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("length", "cell", "kind")]
            keys = np.stack(columns, 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                length, number, kind = keys[a].tolist()
                if (length, number) != at:
                    at, cell, members, counts = (length, number), None, [], []
                found, ns = (batch.column(c).slice(a, b - a).to_pylist() for c in ("word", "n"))
                if kind == 0:
                    members += found
                    counts += ns
                    continue
                if not members:
                    continue
                cell = cell or Cell(members, counts, length)
                for first in range(0, len(found), VISITORS):
                    some, their = found[first : first + VISITORS], ns[first : first + VISITORS]
                    rows, near = cell.near(some, length - (kind == 2))
                    pairs = [(some[i], their[i], members[j], counts[j]) for i, j in zip(rows.tolist(), near.tolist(), strict=True)]
                    pairs += [(m, mn, w, wn) for w, wn, m, mn in pairs] if kind == 2 else []
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=["word", "n", "near", "near_n"])

    routed = words.select("word", "n").mapInArrow(route, ROUTED)
    dealt = routed.repartition("length", "cell").sortWithinPartitions("length", "cell", "kind")
    return staged(dealt.mapInArrow(meet, PAIRS), "near_words")


def followed(links: DataFrame) -> DataFrame:
    """``links`` (word, up), each word once and without circles -> the same with the last word that can be reached.

    Each round doubles the steps taken, so a chain of n words takes about log2(n) rounds.
    """
    links = staged(links, "ups")
    while True:
        further = links.select(F.col("word").alias("up"), F.col("up").alias("top"))
        stepped = staged(links.join(further, "up", "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "ups")
        release(links)
        links = stepped
        if not stepped.filter("moved").head(1):
            return links.select("word", "up")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, typo_rate: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text).

    A word's form is the most frequent of the words one letter apart (of equals the first in code-point order), if it occurs
    ``ratio`` times as often at least; root is where a chain of forms ends.
    """
    words = count_words(docs, least_length, least_count, typo_rate)
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    found = F.col("best.less") * -1 >= F.col("n") * ratio
    formed = staged(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(found, F.col("best.form")).alias("form"),
            F.when(found, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    release(words, pairs)
    roots = followed(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("up")))
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")

"""Removal of passages that occur earlier in the corpus: seed and extend.

Two texts that share ``length`` (20) words share the anchor of those words: winnowing picks, of the
``length - gram + 1`` word n-grams in every window of ``length`` words, the one with the smallest
hash (the last of equal ones).  So anchors, about one for seven words, are the seeds:

1. Seed.  Each document is cut into cells, the runs of windows that have the same anchor.  Cells
   meet by anchor.  A cell all of whose words are those of an earlier cell is a repeat as a whole.
   Anchors that occur once end here, which is most of them.
2. Extend.  Where an anchor has several surroundings, the matches end somewhere within its cells.
   There every window around the anchor (to the left and to the right of it) is looked up among
   the windows around the same anchor; all but the earliest of equal ones are repeats.
3. Maximal repeats.  Overlapping repeated windows are merged, and their words go.

Nothing is paired: groups are reduced to their earliest member, so a passage in a third of all
documents costs a row for each of its occurrences.  Such groups are reduced within a slice of
documents before they are shuffled: of equal cells or windows one is sent, and of the different cells
around one anchor ``ANCHOR_CELLS``, which let it be known as frequent; the others are extended anyway.
Then they are aggregated by Spark, partly before the shuffle, and joined back from written tables, so that
no task holds a whole group.
Seeds are 64-bit hashes, and what counts as equal agrees in 128 (anchor and cell, anchor and window).

Cases: null text has no words; texts of fewer than ``length`` words lose none; rows that share an id
are versions of one document and lose the same positions, and equal ones among them are looked at once in a slice and
gathered once for all; a null id is smaller than any other, and rows
without an id are documents of their own, in the order of a hash of their texts (equal ones count as one
repeated row, which loses nothing to itself); an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged
from .text import as_bytes, slices

LENGTH = 20
GRAM = 7
#: Different cells of one anchor that a slice of documents sends to the anchor's group.
ANCHOR_CELLS = 8
#: Documents without an id go by numbers from here on, made of their texts.
NO_ID, NO_ID_BITS = -(1 << 63), (1 << 62) - 1

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CELLS = "anchor long, cell long, doc long, start int, n int, kind byte"
SEED, REPEAT, EXTEND = 0, 1, 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object)) if words else np.zeros(0, np.uint64)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive numbers."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = out * ODD + h[i : i + len(out)]
    return mixed(out)


class Prefix:
    """Hashes of any ranges of an array of numbers."""

    def __init__(self, h: np.ndarray):
        powers = np.ones(len(h) + 1, np.uint64)
        powers[1:] = ODD
        inverse = np.ones(len(h) + 1, np.uint64)
        inverse[1:] = ODD_INVERSE
        self.inverse = np.cumprod(inverse)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * np.cumprod(powers)[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lengths = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + lengths)


def cut(h: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of documents of ``sizes`` words whose word hashes ``h`` lie one after another:
    anchor hash, cell hash, first window (place in ``h``), number of windows."""
    empty = np.zeros(0, np.int64)
    if len(h) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    grams = run_hashes(h, gram)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # words from here to the document's end
    at = np.nonzero(left >= length)[0]
    if not len(at):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    width = length - gram + 1
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)
    place = np.concatenate([at[i : i + 100_000] + (width - 1 - seen[at[i : i + 100_000], ::-1].argmin(axis=1)) for i in range(0, len(at), 100_000)])
    first = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    return grams[place[first]], Prefix(h)(start, start + n + length - 1), start, n


def _repeated(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """True where an earlier row, by ``order``, has the same ``keys``."""
    at = np.lexsort((*reversed(order), *reversed(keys)))
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in keys:
        same &= k[at][1:] == k[at][:-1]
    out = np.zeros(len(at), bool)
    out[at[1:]] = same
    # equal rows of the same id and place are the same occurrence
    if len(order) == 2 and same.any():
        first = np.zeros(len(at), np.int64)
        first[1:] = ~same
        leader = at[np.nonzero(np.concatenate([[True], ~same]))[0]][np.cumsum(first)]
        out[at] &= ~((order[0][at] == order[0][leader]) & (order[1][at] == order[1][leader]))
    return out


def _versions(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` without rows of the same document and text as an earlier one: they are the same occurrences."""
    docs = np.asarray(batch.column("doc"))
    if len(np.unique(docs)) == len(docs):
        return batch
    seen: set[tuple[int, bytes]] = set()
    keep = []
    for i, row in enumerate(zip(docs.tolist(), as_bytes(batch, "text"), strict=True)):
        if row not in seen:
            seen.add(row)
            keep.append(i)
    return batch.take(pa.array(keep))


def _slice_cells(doc_ids: np.ndarray, texts: list[bytes], length: int, gram: int) -> pa.RecordBatch:
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = word_hashes([w for ws in words for w in ws])
    anchor, cell, place, n = cut(h, sizes, length, gram)
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, place, side="right") - 1 if len(place) else place
    # documents without words share their begin with the next one, which searchsorted finds last
    start, doc = place - begins[of], doc_ids[of]
    kind = np.where(_repeated([anchor, cell], [doc, start]), REPEAT, SEED)
    seeds = np.nonzero(kind == SEED)[0]
    by_anchor = seeds[np.argsort(anchor[seeds], kind="stable")]
    new = np.concatenate([[True], anchor[by_anchor][1:] != anchor[by_anchor][:-1]]) if len(by_anchor) else np.zeros(0, bool)
    nth = np.arange(len(by_anchor)) - np.maximum.accumulate(np.where(new, np.arange(len(by_anchor)), 0))
    kind[by_anchor[nth >= ANCHOR_CELLS]] = EXTEND
    # runs of repeated cells are one row
    repeats = kind == REPEAT
    goes_on = repeats[1:] & repeats[:-1] & (of[1:] == of[:-1]) & (start[1:] == start[:-1] + n[:-1]) if len(of) else np.zeros(0, bool)
    heads = np.nonzero(np.concatenate([[True], ~goes_on]))[0] if len(of) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, heads) if len(heads) else n
    # rows that need not meet others are dealt by document and place, not by anchor
    alone = mixed(doc.astype(np.uint64) * ODD + start.astype(np.uint64))
    cell = np.where(kind == EXTEND, anchor, cell)
    anchor = np.where(kind == SEED, anchor, alone)
    columns = [anchor.view(np.int64), cell.view(np.int64), doc, start.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*(pa.array(c[heads]) for c in columns), pa.array(total.astype(np.int32)), pa.array(kind[heads].astype(np.int8))], names=["anchor", "cell", "doc", "start", "n", "kind"])


def cells(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Cells of ``docs`` (doc, text), see CELLS.

    kind SEED: to be compared by anchor; REPEAT: an earlier one lies in the same slice of documents;
    EXTEND: known to have other surroundings (its anchor is then in the column cell).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in map(_versions, slices(batch, "text")):
                yield _slice_cells(np.asarray(part.column("doc"), np.int64), as_bytes(part, "text"), length, gram)

    return docs.mapInArrow(each, CELLS)


def judged(found: DataFrame) -> DataFrame:
    """Cells that are repeats as a whole or to be extended: doc, start, n, anchor (null: a repeat).

    Groups are aggregated before they are shuffled and joined back plainly, from written tables, so that
    adaptive execution can split an anchor or cell that very many documents have.
    """
    seeds = found.filter(F.col("kind") == SEED).drop("kind")
    by_anchor = seeds.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("cell").alias("_low"), F.max("cell").alias("_high"))
    shared = staged(by_anchor.filter("_n > 1").select("anchor", (F.col("_low") != F.col("_high")).alias("several")), "anchors")
    met = staged(seeds.join(shared, "anchor"), "met")
    release(shared)
    first = staged(_firsts(met, "cell"), "first_cells")
    placed = met.join(first, ["anchor", "cell"], "left")
    later = F.coalesce(F.struct("doc", "start") > F.col("first"), F.lit(False))
    decided = placed.filter(later | F.col("several")).select("doc", "start", "n", F.when(~later, F.col("anchor")).alias("anchor"))
    # what a slice has decided by itself; the anchor of a cell to be extended is in the column cell
    alone = found.filter(F.col("kind") != SEED).select("doc", "start", "n", F.when(F.col("kind") == EXTEND, F.col("cell")).alias("anchor"))
    out = staged(decided.union(alone), "judged")
    release(met, first)
    return out


def _firsts(met: DataFrame, what: str) -> DataFrame:
    """anchor, ``what``, first (doc, start) of those that ``met`` has more than once."""
    groups = met.groupBy("anchor", what).agg(F.count("*").alias("_n"), F.min(F.struct("doc", "start")).alias("first"))
    return groups.filter("_n > 1").drop("_n")


def extended(texts: DataFrame, seeds: DataFrame, length: int = LENGTH) -> DataFrame:
    """Windows of the cells ``seeds`` that occur earlier: doc, start, n (consecutive windows)."""
    by_doc = seeds.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("seeds"))
    schema = "anchor long, win long, doc long, start int, n int"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in map(_versions, slices(whole, "text")):
                found: list[list[np.ndarray]] = [[], [], [], []]
                for doc_id, text, lists in zip(batch.column("doc").to_pylist(), as_bytes(batch, "text"), batch.column("seeds"), strict=True):
                    hashes = run_hashes(word_hashes(text.split()), length)
                    start, n, anchor = (np.asarray(lists.values.field(k)) for k in ("start", "n", "anchor"))
                    inside = start + n <= len(hashes)  # versions of a document may differ in length
                    start, n, anchor = start[inside], n[inside], anchor[inside]
                    at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                    for out, x in zip(found, (np.repeat(anchor, n), hashes[at].view(np.int64), np.full(len(at), doc_id, np.int64), at.astype(np.int32)), strict=True):
                        out.append(x)
                anchor, win, doc, at = (np.concatenate(x) for x in found)
                again = _repeated([anchor, win], [doc, at])
                # what occurs earlier in this slice is decided and is not to meet in one group
                anchor = np.where(again, mixed(doc.astype(np.uint64) * ODD + at.astype(np.uint64)).view(np.int64), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(win), pa.array(doc), pa.array(at), pa.array(again.astype(np.int32))], names=["anchor", "win", "doc", "start", "n"])

    met = staged(texts.join(by_doc, "doc").mapInArrow(windows, schema), "windows")
    first = staged(_firsts(met.filter("n = 0"), "win"), "first_windows")
    later = met.filter("n = 0").join(first, ["anchor", "win"]).filter(F.struct("doc", "start") > F.col("first"))
    out = staged(later.select("doc", "start", F.lit(1).alias("n")).union(met.filter("n = 1").select("doc", "start", "n")), "repeats")
    release(met, first)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, spans
    (maximal repeats: first word, one past the last) and, if asked for, kept_text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(NO_ID_BITS)) + F.lit(NO_ID)))
    found = staged(cells(texts, length, gram), "cells")
    known = judged(found)
    release(found)
    around = extended(texts, known.filter("anchor IS NOT NULL"), length)
    gone = known.filter("anchor IS NULL").select("doc", "start", "n").union(around)
    by_doc = gone.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,end:int>>" + (", kept_text string" if keep_text else "")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[list] = [[], [], [], [], []]
                for text, lists in zip(as_bytes(batch, "text"), batch.column("gone"), strict=True):
                    words = text.split()
                    spans: list[dict] = []
                    total, removed = len(words), 0
                    if lists.is_valid:
                        edges = np.zeros(total + 1, np.int32)
                        start, n = (np.asarray(lists.values.field(k)) for k in ("start", "n"))
                        np.add.at(edges, np.minimum(start, total), 1)
                        np.add.at(edges, np.minimum(start + n + length - 1, total), -1)
                        out = np.cumsum(edges[:-1]) > 0
                        removed = int(out.sum())
                        turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]))).tolist()
                        spans = [{"first": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                        words = [w for w, g in zip(words, out.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    for column, value in zip(rows, (total, removed, hashlib.sha256(kept).hexdigest(), spans, kept.decode() if keep_text else None), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.string()]
                columns = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns][: 6 if keep_text else 5], names=names[: 6 if keep_text else 5])

    return texts.join(by_doc, "doc", "left").mapInArrow(keep, schema)

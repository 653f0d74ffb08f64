"""Best-fit packing of tokenized documents into sequences of a fixed length.

1. Texts are tokenized in place (Arrow batches) into pieces: one for a document of at most
   ``capacity`` tokens, else as many full ones as possible after one shorter first piece.
2. Pieces are counted by length.  This histogram, ``capacity`` numbers whatever the corpus,
   is all that the driver sees.
3. Best fit decreasing is planned over counts: sequences of equal fill are one run, and a run
   takes as many pieces of a length at once as its room and the count allow.
4. A piece of length L and rank k among the pieces of that length takes the k-th slot planned
   for L.  Ranks are taken in parts (see ``ranks``), so a length that very many pieces have is
   no task's load.

Texts are never shuffled.  Cases: null text is empty, an empty document is its end token alone;
repeated rows are packed each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .staging import staged
from .text import slices
from .tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    bounds = [(0, first)] if first else []
    return bounds + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``with_ids`` adds the ids themselves (array of int)."""
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks)
        for whole in batches:
            for batch in slices(whole, "text"):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([enc.encode(text or ""), end])
                    for i, (start, n) in enumerate(piece_bounds(len(ids), capacity)):
                        part = ids[start : start + n]
                        for k, v in (("doc_id", doc_id), ("piece", i), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(part.tobytes()))):
                            out[k].append(v)
                        if with_ids:
                            out["ids"].append(part.astype("i4"))
                columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
                names = list(out)[:5]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots for ``histogram`` (length: count) as runs, one row each, ordered by length and rank:
    length, first rank, pieces in the run, first sequence, offset.

    The piece of that length and rank ``first rank + i`` lies in ``first sequence + i`` at ``offset``.
    There are at most a few runs for each pair of lengths, however many documents there are.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, number)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        left, rank, room = histogram[length], 0, length
        while left:
            while room < capacity and not rooms[room]:
                room += 1
            if room >= capacity:  # no open sequence has room
                each = min(capacity // length, left)
                rooms[capacity].append((sequences, left // each))
                sequences += left // each
                room = capacity
            first, number = rooms[room].pop()
            each = min(room // length, left)
            used = min(number, left // each)
            if used < number:
                rooms[room].append((first + used, number - used))
            for i in range(each):
                slots.append((length, rank, used, first, capacity - room + i * length))
                rank += used
            left -= each * used
            rooms[room - each * length].append((first, used))
            room = length  # what was left over may fit better now
    runs = np.array(slots, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(slots)
    names = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id long", "offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), np.int64) for k in ("length", "rank"))
            run = runs[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            placed = [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *placed], names=[*names, "sequence_id", "offset"])

    return ranked(pieces, ["length"], [], ["doc_id", "piece"]).select(*names, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) once, write the pieces (not their ids) and place them."""
    return pack(staged(tokenized(docs, tokenizer, ranks, capacity, end_id), "pieces"), capacity)

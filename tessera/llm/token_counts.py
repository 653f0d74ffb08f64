"""Token counts of texts without their token ids.

A byte-level BPE cuts a text into pre-tokens and tokenizes each on its own, so a text has as many tokens as its
pre-tokens together.  Texts are cut once, in blocks of some megabytes; a block keeps its distinct pre-tokens and, for
each document, how often each of them occurs.  Each distinct pre-token of all blocks is tokenized once, for its number of
tokens only.  The numbers are joined to the blocks' pre-tokens by a plain shuffle (a pre-token as frequent as a blank is
one row a block, and adaptive execution splits a key with many blocks), gathered by block, and summed over the
documents' frequencies.  What is shuffled by pre-token is one row for each distinct pre-token of a block, never text.

Cases: a null text counts as empty and has no tokens; a null id stays null; repeated rows are counted each; an empty
table gives an empty result; further columns are not looked at.  A text longer than a block is a block of its own; it is
cut as a stream, so what is held is its distinct pre-tokens.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged
from .text import slices
from .tokens import PATTERN, encoder

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 32_000_000

#: Characters of a text beyond which its pre-tokens are not listed before they are counted.
LONG_TEXT = 1_000_000

#: Bits for the tokens of a pre-token, which are fewer than its bytes.
TOKEN_BITS = 31

BLOCKS = "block long, pieces array<string>, doc_id array<long>, n_bytes array<long>, entries array<long>, body binary"


class Cutter:
    """Pre-tokens of texts, as the tokenizer file ``path`` cuts them.

    The file must be a byte-level BPE with the usual split pattern and without a normalizer.  Strings of special tokens
    are cut out first and are pieces themselves, which is the default of ``tokenizers``.
    """

    def __init__(self, path: str):
        import json

        import regex

        coder = encoder(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if parts["normalizer"] or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.exact = coder.tokenizer.pre_tokenizer
        self.pattern = regex.compile(PATTERN)
        special = sorted(coder.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def count(self, text: str) -> Counter[str]:
        """Pre-tokens of ``text`` and how often each occurs."""
        found: Counter[str] = Counter()
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                found[part] += 1
            elif not part.isascii() and any(unicodedata.category(c) == "Cn" for c in set(part)):
                # characters younger than Python's tables may be letters to one library and not to the other
                found.update(part[a:b] for _, (a, b) in self.exact.pre_tokenize_str(part))
            elif len(part) > LONG_TEXT:
                found.update(m[0] for m in self.pattern.finditer(part))
            else:
                found.update(self.pattern.findall(part))
        return found


_cutters: dict[str, Cutter] = {}


def cutter(path: str) -> Cutter:
    """One for each worker process and file."""
    if path not in _cutters:
        _cutters[path] = Cutter(path)
    return _cutters[path]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 as compressed planes of their bytes; small numbers take little more than their lowest."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class Block:
    """Documents whose pre-tokens are counted together: the distinct ones, and by document places among them and frequencies."""

    def __init__(self) -> None:
        self.size = 0
        self.places: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.entries: list[int] = []
        self.steps: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id: int | None, size: int, found: Counter[str]) -> None:
        """Places ascend within a document and are kept as differences (the first one as it is)."""
        places = self.places
        at = np.fromiter((places.setdefault(piece, len(places)) for piece in found), np.int32, len(found))
        order = np.argsort(at)
        self.steps.append(np.diff(at[order], prepend=np.int32(0)))
        self.times.append(np.fromiter(found.values(), np.uint32, len(found))[order])
        self.entries.append(len(found))
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.size += size

    def row(self, block: int) -> dict:
        # two streams of their own, so that each compresses as what it is
        streams = [packed(np.concatenate(s)) for s in (self.steps, self.times)]
        body = len(streams[0]).to_bytes(8, "little") + streams[0] + streams[1]
        return {"block": block, "pieces": list(self.places), "doc_id": self.ids, "n_bytes": self.sizes, "entries": self.entries, "body": body}


def block_sums(entries: list[int], body: bytes, tokens: np.ndarray) -> np.ndarray:
    """Tokens of each document of a block, from the tokens of each of the block's pre-tokens."""
    n, out = sum(entries), np.zeros(len(entries), np.int64)
    if not n:
        return out
    cut = 8 + int.from_bytes(body[:8], "little")
    steps, times = (unpacked(part, n).astype(np.int64) for part in (body[8:cut], body[cut:]))
    counts = np.array(entries)
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    # running sums of the differences, started anew with each document
    sums = np.cumsum(steps)
    at = sums - np.repeat(sums[starts] - steps[starts], counts[some])
    out[some] = np.add.reduceat(tokens[at] * times, starts)
    return out


def count_tokens(docs: DataFrame, path: str, ranks: str | None = None, limit: int = 512, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row of ``docs`` (doc_id, text).

    Counts are those of ``tokenizers`` for the file ``path``, without added special tokens; ``ranks`` as for ``Encoder``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, held = cutter(path), TaskContext.get().partitionId() << 33, Block()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, size, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "text")), strict=True):
                    if held.ids and held.size + size > block_bytes:
                        yield pa.RecordBatch.from_pylist([held.row(block)], schema=block_schema)
                        held, block = Block(), block + 1
                    held.add(doc_id, size, own.count(text or ""))
        if held.ids:
            yield pa.RecordBatch.from_pylist([held.row(block)], schema=block_schema)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ranks)
        for batch in batches:
            pieces = batch.column("piece")
            tokens = [len(own.encode(piece)) for piece in pieces.to_pylist()]
            yield pa.RecordBatch.from_arrays([pieces, pa.array(tokens, pa.int64())], names=["piece", "tokens"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                tokens = np.zeros(len(row["found"]), np.int64)
                if len(tokens):
                    found = np.asarray(row["found"].values)
                    tokens[found >> TOKEN_BITS] = found & ((1 << TOKEN_BITS) - 1)
                sums = block_sums(row["entries"].as_py(), row["body"].as_py(), tokens)
                arrays = [row["doc_id"].values, row["n_bytes"].values, pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    block_schema = pa.schema(
        [("block", pa.int64()), ("pieces", pa.list_(pa.string()))]
        + [(c, pa.list_(pa.int64())) for c in ("doc_id", "n_bytes", "entries")]
        + [("body", pa.binary())]
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_bytes"))
    blocks = staged(rows.mapInArrow(cut, BLOCKS), "blocks")
    pieces = blocks.select("block", F.posexplode("pieces").alias("place", "piece"))
    counted = staged(pieces.select("piece").distinct().mapInArrow(tokenize, "piece string, tokens long"), "piece_tokens")
    # place and tokens as one number: an array of numbers is a quarter of an array of structs
    found = F.shiftleft(F.col("place").cast("long"), TOKEN_BITS).bitwiseOR(F.col("tokens"))
    met = pieces.join(counted, "piece").groupBy("block").agg(F.collect_list(found).alias("found"))
    # a block without pre-tokens meets nothing
    whole = blocks.drop("pieces").join(met, "block", "left").withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    sums = staged(whole.mapInArrow(add_up, "doc_id long, n_bytes long, n_tokens long"), "token_counts")
    release(blocks, counted)
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)

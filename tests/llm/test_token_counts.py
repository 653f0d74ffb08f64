"""Token counts against the tokenizer itself."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("regex")
pytest.importorskip("public_tokenizers")

from tessera.llm import token_counts  # noqa: E402
from tessera.llm.queries import op12_token_counts, tokenizer_files  # noqa: E402
from tessera.llm.tokens import encoder  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
#: White space of several kinds, letters of several scripts, a letter younger than Python's tables, a special token.
PARTS = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "!", "9", "<|endoftext|>", "<|", "՘", "　", "\xa0", "語", "\U0001f600", "́", "\x1c", "​", "don't", " The"]


def counted(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())


def by_tokenizer(rows):
    whole = encoder(tokenizer_files()[0])
    lengths = [(i, len((t or "").encode()), len(whole.encode(t or ""))) for i, t in rows]
    return sorted((str(i), n, tokens, tokens > 512) for i, n, tokens in lengths)


@pytest.mark.parametrize("block_bytes", [1, 3000, 32_000_000])
def test_counts_are_those_of_the_tokenizer_in_any_blocks(spark, block_bytes):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(None, None), (5, ""), (5, ""), (6, " \n"), (7, "x" * 9000), (8, " " * 20000 + "a"), (9, "ab <|endoftext|>\n" * 90_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert counted(token_counts.count_tokens(docs, *tokenizer_files(), block_bytes=block_bytes)) == by_tokenizer(rows)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert counted(op12_token_counts(spark, SF)) == by_tokenizer(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "p")], SCHEMA + ", block long, piece string")
    assert counted(token_counts.count_tokens(docs, *tokenizer_files())) == by_tokenizer([(1, "a b")])
    assert token_counts.count_tokens(docs.limit(0), *tokenizer_files()).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.Cutter(public_tokenizers.path("word_bpe_49k.json"))


def test_packed_numbers():
    import numpy as np

    for numbers in ([], [0], [1, 2**32 - 1, 300, 70000]):
        assert token_counts.unpacked(token_counts.packed(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers

"""The registered queries of this subpackage, with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import exact_dedup, image_copies, langid, line_dedup, merkle, mil_toxicity, mixing, packing, pu_quality, simhash, spelling, substring_dedup, token_counts
from .merkle_sql import manifest_sql
from .spelling_sql import VARIANTS_SQL
from .staging import staged
from .text import word_count

#: Rows of text that are handed to Python at once; texts may be long.
BATCH_ROWS = 2000

#: Vectors whose pictures are made and described by one task, a few seconds of work, however few and large the files of the table are.
VECTORS_A_TASK = 600

#: One row in so many of the manifest is offered tampered.
TAMPERED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    """The byte-level BPE vocabulary, as tokenizer and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes the table into a new index as two batches, the second of which meets what the first one added; the index
    is dropped again, as what the result needs of it is written by then."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", exact_dedup.DigestIndex.buckets_for(docs.count()))
    decided = index.take_halves(docs)
    index.drop()
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures made of all vectors, and edited copies among them; queries are the ids divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.repartition(max(1, -(-vectors.count() // VECTORS_A_TASK)))
    return image_copies.copies_among(image_copies.described_pictures(vectors, 100))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the texts are read once, for their sizes
    sizes = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    return mixing.taken_copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the profiles are counted on all labelled documents."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *tokenizer_files())


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in seven, by the hash of its id, is offered with one character more than it has."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return merkle.documents_manifest(table(spark, sf_dir, "documents"), tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_image_copies": op4_image_copies,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_counts": op12_token_counts,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op11_spelling_variants": VARIANTS_SQL,
    "op13_merkle": manifest_sql(TAMPERED),
    "op2_exact_dedup": """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""",
    "op8_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0
             - coalesce(sum(2 * source_size) OVER earlier, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, (max(level) OVER ())::DOUBLE * weight) AS target,
         ('0x' || substr(md5('7|' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least((floor((place + 1) * rate + shift) - floor(place * rate + shift))::BIGINT, 2) * size AS taken
FROM placed
""",
}

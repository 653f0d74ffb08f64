"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import pytest

pytest.importorskip("xxhash")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import pu_quality, simhash  # noqa: E402
from tessera.llm.staging import staged  # noqa: E402

from .test_ops import brute_fingerprint, lower  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        out.append((name, docs))
    return dict(out)


def test_names_and_columns(stages):
    assert list(stages)[1:] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    columns = stages["input"].columns
    assert all(df.columns == columns for name, df in list(stages.items())[:-1])


def test_quality_stage(spark, stages):
    rejected = {r["doc_id"] for r in pu_quality.scored(stages["input"], spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    everything = {r["doc_id"] for r in stages["input"].collect()}
    assert {r["doc_id"] for r in stages["quality classifier"].collect()} == everything - rejected
    assert rejected and len(rejected) < len(everything) / 2


def test_exact_stage(stages):
    last: dict[str, int] = {}
    for r in stages["quality classifier"].collect():
        last[lower(r["text"])] = max(r["doc_id"], last.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in stages["exact dedup"].collect()) == sorted(last.values())


def test_near_stage(stages):
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in stages["exact dedup"].collect()}
    roots = {i: i for i in fps}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in stages["SimHash near-dedup"].collect()) == sorted({find(i) for i in fps})


def test_mixing_stage(stages):
    before = {r["doc_id"]: r for r in stages["SimHash near-dedup"].collect()}
    after = stages["mixing sources to target weights"].groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).collect()
    assert all(r["n"] in (1, 2) and before[r["doc_id"]]["text"] == r["text"] for r in after)
    words = sum(len((r["text"] or "").split()) for r in before.values())
    taken = sum(r["n"] * len((r["text"] or "").split()) for r in after)
    assert 1.2 * words < taken < 1.8 * words


def test_packing_stage(spark, stages):
    rows = stages["best-fit packing"].collect()
    copies = {r["doc_id"]: r["n"] for r in stages["mixing sources to target weights"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    firsts: dict[int, int] = {}
    fill: dict[int, list] = {}
    for r in rows:
        firsts[r["doc_id"]] = firsts.get(r["doc_id"], 0) + (r["piece"] == 0)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert firsts == copies
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(map(tuple, rows), key=str) is not None
    again = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, stages["best-fit packing"].select(columns).collect()))


def test_null_and_repeated_ids_in_the_near_stage(spark):
    words = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(5)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (1, words[2]), (1, words[2]), (1, words[2].upper()), (1, words[3]), (2, words[3]), (None, words[3]), (3, words[4]), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in simhash.keep_one_each(docs).collect()), key=str)
    assert kept == sorted([(None, words[0]), (None, words[1]), (1, words[2]), (1, words[3]), (3, words[4]), (None, "")], key=str)


def test_null_and_repeated_ids_in_the_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in stages["input"].collect()}
    verdict = {r["doc_id"]: r["predicted"] for r in pu_quality.scored(stages["input"], labels).collect()}
    bad = [i for i, p in sorted(verdict.items()) if not p][0]
    good = [i for i, p in sorted(verdict.items()) if p][0]
    # the id of the good document also has the bad one's text, and both texts come without an id
    more = spark.createDataFrame([(good, text[bad]), (None, text[bad]), (None, text[good])], "doc_id long, text string")
    docs = stages["input"].select("doc_id", "text").union(more)
    fresh = pu_quality.scored(docs, labels)
    scores = {(r["doc_id"], r["score"]): r["predicted"] for r in fresh.collect()}
    assert len({p for (i, _), p in scores.items() if i is None}) == 2
    kept = [(r["doc_id"], r["text"]) for r in pu_quality.keep_good(docs, labels).collect()]
    assert (None, text[good]) in kept and (None, text[bad]) not in kept
    assert (good, text[good]) in kept and (good, text[bad]) not in kept
    assert len(kept) == fresh.filter("predicted = 1").count()

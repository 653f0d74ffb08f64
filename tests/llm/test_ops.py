"""The operators against brute force on small fixtures with the awkward cases among their rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("xxhash")
pytest.importorskip("pyarrow")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import components, exact_dedup, mixing, packing, simhash, substring_dedup  # noqa: E402
from tessera.llm.queries import SQL, op8_mixing, tokenizer_files  # noqa: E402
from tessera.llm.ranks import ranked  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "Theta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    passage = some_words(rng, 60)
    rows = []
    for i in range(60):
        text = some_words(rng, rng.choice([0, 1, 2, 3, 19, 20, 21, 80, 300]))
        if i % 4 == 0:
            text = some_words(rng, 30) + "\n" + passage + "\t" + some_words(rng, 25)
        rows.append((i, text, "en", f"src{i % 5}", 1))
    rows += [(100 + i, rows[4][1].upper() if i % 2 else rows[4][1], "en", "src0", 1) for i in range(30)]
    rows += [(200, None, None, None, None), (201, "", None, "src1", 0), (202, " \t\n", "en", None, 3), (203, "same " * 500, "en", "src2", 9), (204, some_words(rng, 9000), "de", "src3", 9)]
    rows += [(205, " x y \u0085z ÀÉ", "fr", "src3", 9), (206, rows[8][1] + " end", "en", "src4", 1), (207, "İstanbul ÀB", "tr", "ÿ", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts_of(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.collect())


def brute_repeats(docs, length=20):
    seen, out = set(), {}
    for doc_id, text in texts_of(docs):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            if key in seen:
                gone[p : p + length] = [True] * length
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(docs)


def test_substring_dedup_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(table).collect()}
    assert got == brute_repeats(table)


def test_substring_dedup_spans_and_text(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words) + " y"), (None, None)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert got[2]["kept_text"] == "x y" and [tuple(s) for s in got[2]["spans"]] == [(1, 26)]
    assert got[1]["n_removed"] == 0 and got[None]["n_words"] == 0


def test_substring_dedup_frequent_anchor_in_many_surroundings(spark):
    """More different cells around one anchor than a slice sends to the anchor's group."""
    core = " ".join(f"core{i}" for i in range(12))
    rows = [(i, " ".join(f"a{i}_{k}" for k in range(10)) + " " + core + " " + " ".join(f"b{i % 7}_{k}" for k in range(10))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(df)


def test_exact_dedup_matches_brute_force(spark, docs):
    index = exact_dedup.DigestIndex(spark, "t_digests", 4)
    index.drop()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in index.ingest(docs).collect()}
    groups: dict[str, list[int]] = {}
    for doc_id, text in texts_of(docs):
        groups.setdefault(lower(text), []).append(doc_id)
    expected = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == expected
    # a second batch meets the index: known texts are dropped, new ones appended once
    more = spark.createDataFrame([(300, (texts_of(docs)[10][1])), (301, "new"), (302, "NEW"), (302, "NEW")], "doc_id long, text string")
    again = sorted((r["doc_id"], r["keep_id"], r["kept"], r["known"]) for r in index.ingest(more).collect())
    assert again[0] == (300, expected[texts_of(docs)[10][0]][0], False, True)
    assert [r[1:] for r in again[1:2]] == [(302, False, False)] and sorted(r[2] for r in again[2:]) == [False, True]
    assert index.read().count() == len(groups) + 1
    index.drop()


def test_exact_dedup_keeps_one_row_each(spark, docs):
    twice = docs.union(docs)
    index = exact_dedup.DigestIndex(spark, "t_digests2", 4)
    index.drop()
    decided = index.ingest(twice).cache()
    kept = exact_dedup.keep_rows(twice, decided)
    assert kept.columns == twice.columns
    assert sorted(lower(r["text"]) for r in kept.collect()) == sorted({lower(t) for _, t in texts_of(docs)})
    index.drop()


def test_index_side_of_the_anti_join_is_neither_shuffled_nor_sorted(spark, docs):
    index = exact_dedup.DigestIndex(spark, "t_digests3", 4)
    index.drop()
    index.ingest(docs).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    new = docs.select(F.sha2("text", 256).alias("text_sha256")).distinct()
    plan = new.join(index.read().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    index.drop()
    right = plan[plan.index("Bucketed: true") :] if "Bucketed: true" in plan else ""
    assert "SortMergeJoin" in plan and right and "Exchange" not in right


def brute_fingerprint(text):
    import xxhash

    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(spark, docs):
    rng = random.Random(1)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts_of(docs)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    roots = {i: i for i in fps}

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in sorted(fps):
        for j in sorted(fps):
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in fps}
    assert rng is not None


@pytest.mark.parametrize("bias", [0, 40])
def test_all_pairs_within_two_bits_are_found(spark, bias):
    """Random fingerprints with planted neighbours; a bias makes bits correlated and buckets uneven."""
    rng = random.Random(bias)
    base = [rng.getrandbits(64 - bias) for _ in range(60)]
    values = set(base) | {b ^ 1 << rng.randrange(64) for b in base} | {b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base}
    signed = [simhash.signed(v) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    parts = simhash.plan_parts(fps)
    assert sum(p.threshold for p in parts) == 2 - len(parts) + 1
    assert {(r["a"], r["b"]) for r in simhash.near_pairs(fps, parts).collect()} == expected
    # any division of the thresholds gives the same pairs
    for thresholds in ((1, 0), (-1, 2), (2, -1)):
        halves = [simhash.Part(list(range(32)), thresholds[0]), simhash.Part(list(range(32, 64)), thresholds[1])]
        assert {(r["a"], r["b"]) for r in simhash.near_pairs(fps, halves).collect()} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(205, 203), (203, 204), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {203: 203, 204: 203, 205: 203}
    assert got == expected
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_do_not_depend_on_parts_being_split(spark):
    df = spark.createDataFrame([(("x" if i % 3 else "y"), i % 2, i) for i in range(300)], "g string, v long, id long")
    for rows in (1000, 20):
        got = ranked(df, ["g"], ["v"], ["id"], rows).collect()
        for g in "xy":
            mine = sorted((r["rank"], r["v"]) for r in got if r["g"] == g)
            assert [r for r, _ in mine] == list(range(len(mine)))
            assert [v for _, v in mine] == sorted(v for _, v in mine)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing_targets_and_copies(docs):
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    rows = mixing.taken_copies(sizes).collect()
    assert len(rows) == docs.count()
    totals: dict = {}
    for r in rows:
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
    expected = brute_targets(totals)
    taken: dict = {}
    for r in rows:
        assert r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    largest = {s: max(r["size"] for r in rows if r["source"] == s) for s in totals}
    for s, n in taken.items():
        assert abs(n - expected[s]) <= 2 * largest[s]


def test_mixed_rows_agree_with_copies(spark, docs):
    twice = docs.union(docs.filter("doc_id < 5"))
    mixed = mixing.mix(twice)
    assert mixed.columns == docs.columns
    sizes = twice.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    assert mixed.count() == mixing.taken_copies(sizes).agg(F.sum("copies")).first()[0]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(twice).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing_plan_places_everything(docs):
    for capacity, lengths in ((10, [1, 2, 3, 10, 7, 7, 5, 5, 5, 9]), (2048, [random.Random(i).randint(1, 2048) for i in range(700)])):
        histogram: dict[int, int] = {}
        for n in lengths:
            histogram[n] = histogram.get(n, 0) + 1
        fill: dict[int, list] = {}
        count: dict[int, int] = {}
        for length, rank, n, first, offset in packing.plan(histogram, capacity).tolist():
            assert count.get(length, 0) == rank
            count[length] = rank + n
            for i in range(n):
                fill.setdefault(first + i, []).append((offset, length))
        assert count == histogram
        for placed in fill.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(fill) <= -(-sum(lengths) // capacity) * 1.15 + 1


def test_packed_documents(docs):
    import numpy as np
    from tokenizers import Tokenizer

    path, ranks = tokenizer_files()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, ranks).collect()
    by_doc: dict[int, list] = {}
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in texts_of(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert k == 0 or p["length"] == 2048
            at += p["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // 2048)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


def test_fast_ids_equal_those_of_the_tokenizer():
    from tessera.llm.tokens import Encoder

    path, ranks = tokenizer_files()
    fast, plain = Encoder(path, ranks), Encoder(path)
    rng = random.Random(3)
    texts = ["", " ", "a  b \n c", "<|endoftext|> x <|endoftext|>", "it's 12 o'clock", "  \u0085"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(200)) for _ in range(30)]
    for text in texts:
        assert fast.encode(text).tolist() == plain.encode(text).tolist()


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, *tokenizer_files()).count() == 0
    index = exact_dedup.DigestIndex(spark, "t_digests4", 4)
    assert index.ingest(none).count() == 0
    index.drop()


def test_extra_columns_with_clashing_names(spark, docs):
    extra = docs.withColumns({c: F.lit(1) for c in ("fp", "rank", "size", "copies", "kept", "row", "component_id", "keep_id", "anchor", "length")})
    assert substring_dedup.remove_repeats(extra).count() == docs.count()
    assert simhash.keep_one_each(extra).columns == extra.columns
    assert mixing.mix(extra).columns == extra.columns
    index = exact_dedup.DigestIndex(spark, "t_digests5", 4)
    index.drop()
    assert exact_dedup.keep_rows(extra, index.ingest(extra)).columns == extra.columns
    index.drop()


def test_mixing_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.sql(SQL["op8_mixing"])
    expected = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r) for r in op8_mixing(spark, SF).select(*found.columns).collect()) == expected

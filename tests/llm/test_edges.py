"""Awkward rows, columns and values, and brute-force versions of what the learned operators compute."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pytest

pytest.importorskip("xxhash")
pytest.importorskip("pyarrow")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import exact_dedup, image_copies, langid, line_dedup, mil_toxicity, mixing, packing, pu_quality, simhash, staging, substring_dedup  # noqa: E402
from tessera.llm.queries import tokenizer_files  # noqa: E402
from tessera.llm.ranks import ranked  # noqa: E402
from tessera.llm.tokens import Encoder  # noqa: E402
from tessera.session import ship_package  # noqa: E402

#: Names that operators use themselves, and a name with a dot.
CLASHES = ("row", "size", "copy", "copies", "nth", "digest", "its_id", "its_digest", "_n", "_digest", "_id", "_mix_size", "rank", "a.b")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with null ids, repeated rows and clashing columns."""
    ship_package(spark)
    texts = [(1, "a quiet house by the river"), (2, "A quiet house by the river"), (None, "lonely words without any id"), (None, "lonely words without any id"), (3, None), (4, ""), (4, "")]
    texts += [(10 + i, f"document {i} speaks of matter number {i * 7} and of nothing else") for i in range(8)]
    df = spark.createDataFrame([(i, t, "src") for i, t in texts], "doc_id long, text string, source string")
    return df.select("*", *(F.lit(77).alias(c) for c in CLASHES))


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_carry_any_columns(spark, clashing):
    index = exact_dedup.DigestIndex(spark, f"edges_{uuid.uuid4().hex}", 4)
    exact = exact_dedup.keep_rows(clashing, index.take_halves(clashing))
    near = simhash.keep_one_each(clashing)
    mixed = mixing.mix(clashing)
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 0)], "doc_id long, quality int")
    good = pu_quality.keep_good(clashing, labels, threshold=0.0)
    for out in (exact, near, mixed, good):
        assert out.columns == clashing.columns
        assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {(77,) * len(CLASHES)}
    index.drop()
    # equal texts: the largest id, null the smallest; of repeated rows one
    assert (2, "A quiet house by the river") in rows_of(exact) and (1, "a quiet house by the river") not in rows_of(exact)
    assert rows_of(exact).count((None, "lonely words without any id")) == 1
    assert rows_of(near).count((None, "lonely words without any id")) == 1
    assert rows_of(good) == rows_of(clashing)


def test_second_batch_meets_the_index(spark):
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)] + [(None, "text 0"), (None, "alone")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"edges_{uuid.uuid4().hex}", 4)
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in index.take_halves(docs).collect()}
    per_batch = {r["batch"]: r["n"] for r in index.read().groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(per_batch.values()) == [1, 5], "the second batch adds only what the first one did not hold"
    assert sum(kept for _, _, kept in got.values()) == 6
    for (doc_id, _), (keep_id, group_size, _) in got.items():
        if doc_id is not None:
            assert (keep_id, group_size) == (15 + doc_id % 5, 5 if doc_id % 5 == 0 else 4)
    plan = spark.table(index.name).join(index.read().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, "the index is not shuffled"
    index.drop()


def test_ranks_have_one_order_for_any_division(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 2).alias("size"), "id")
    orders = [{r["id"]: r["rank"] for r in ranked(df, ["g"], ["size"], ["id"], block_rows=b).collect()} for b in (10, 300, 10**6)]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0].values()) == list(range(5000))


def test_lines_of_white_space_stay(spark):
    docs = spark.createDataFrame([(1, "\r\nsame words in this line\r\n \t"), (2, "\r\nsame words in this line \n\x0b"), (None, None), (2, "SAME words in this line")], "doc_id long, text string")
    docs = docs.withColumn("line", F.lit(1)).withColumn("k1", F.lit("x"))
    got = sorted(((r["doc_id"], r["line_no"], r["first_doc_id"], r["kept"]) for r in line_dedup.deduplicate_lines(docs).collect()), key=repr)
    words = [g for g in got if g[2] != g[0] or g[0] == 1 and g[1] == 1]
    assert {g[:2] for g in words} == {(1, 1), (2, 0), (2, 1)} and [g for g in words if g[3]] == [(1, 1, 1, True)]
    assert all(g[3] for g in got if g not in words)
    assert line_dedup.deduplicate_lines(docs.limit(0)).count() == 0


def test_banding_recall():
    """Chance to share a bucket, for lines whose minima agree independently with their similarity."""
    rng = np.random.default_rng(1)
    for similarity, least in ((0.8, 0.99), (0.85, 0.998)):
        agree = rng.random((40_000, line_dedup.MINIMA)) < similarity
        met = np.any([agree[:, rows].all(axis=1) for rows in line_dedup.BAND_ROWS], axis=0)
        assert met.mean() >= least


def test_long_white_space_is_tokenized(spark):
    from tokenizers import Tokenizer

    paths = tokenizer_files()
    exact, enc = Tokenizer.from_file(paths[0]), Encoder(*paths)
    for text in (" " * 200_000, "a" + "\n" * 30_000 + "b", " " * 9_999 + "x"):
        assert enc.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    ship_package(spark)
    docs = spark.createDataFrame([(1, " " * 1_000_000), (None, "x"), (None, "x"), (2, None)], "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack_documents(docs, *paths).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(exact.encode(" " * 1_000_000, add_special_tokens=False).ids) + 1
    assert len([r for r in got if r["doc_id"] is None]) == 2


def test_any_vector_has_a_picture(spark):
    ship_package(spark)
    vectors = [[math.nan, 1.0], [math.inf, 1.0], [0.0, 1.0], [1e30, -1e30], [0.5, -0.25], [-0.5, 0.25]]
    df = spark.createDataFrame([(4 * i + 3, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    pixels = {r["media_id"] // 4: bytes(r["pixels"]) for r in image_copies.media_table(df).collect()}
    assert pixels[3] == pixels[7] == pixels[11] and pixels[19] != pixels[23] and len(pixels) == 6


def test_turned_picture_is_found_and_matches_equal_brute_force(spark):
    ship_package(spark)
    rows, images = [], []
    for i in range(14):
        image = image_copies.picture(np.array([i + 0.5, 2.0 * i]))
        images.append(image)
        rows.append((100 * i, image))
    rows.append((1, np.rot90(images[3])))
    rows.append((2, images[5] * 0.8 + 20))
    media = spark.createDataFrame([(i, x.shape[1], x.shape[0], bytearray(np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()), "c") for i, x in rows], "media_id long, width int, height int, pixels binary, inliers string")
    found = {(r["query_id"], r["media_id"]): r["turn"] for r in image_copies.find_copies(media, F.col("media_id") % 100 == 0).collect()}
    assert {(300, 1), (500, 2)} <= set(found) and found[500, 2] == 0.0 and found[300, 1] % 90 == 0 and found[300, 1] != 0
    corners = image_copies.descriptors(media).collect()
    words = np.array([[r[f"w{j}"] for j in range(4)] for r in corners], np.uint64)
    bits = np.unpackbits(words.astype("<u4").view(np.uint8).reshape(len(words), -1), axis=1)
    apart = (bits[:, None] != bits[None]).sum(axis=2)
    near = {(corners[a]["media_id"], corners[a]["corner"], corners[b]["media_id"], corners[b]["corner"]) for a, b in zip(*np.nonzero(apart <= image_copies.MOST_BITS), strict=True) if corners[a]["media_id"] != corners[b]["media_id"]}
    df = image_copies.descriptors(media)
    met = [(r["q_media_id"], r["q_corner"], r["m_media_id"], r["m_corner"]) for r in image_copies.matches(df, df).collect()]
    assert set(met) == near and len(met) == len(near), "all pairs within the distance, each once"


def test_all_strong_corners_describe_a_picture():
    """A small crop of a picture full of corners keeps those that lie in it."""
    image = image_copies.picture(np.array([1.5, 2.5]), 240)
    whole, part = image_copies.describe(image), image_copies.describe(image[60:170, 90:200])
    assert len(whole[0]) > 500
    inside = {tuple(w) for w in whole[1]}
    level = part[0][:, 2] == 1.0
    assert level.sum() > 20 and np.mean([tuple(w) in inside for w in part[1][level]]) > 0.9


def test_risk_and_its_slope_by_numpy(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, pu_quality.N_FEATURES)).astype(np.float32)
    good = (x[:, 0] > 0) & (rng.random(400) < 0.5)
    table = spark.createDataFrame([(r.tolist(), bool(g)) for r, g in zip(x, good, strict=True)], "x array<float>, good boolean").repartition(5)
    mean, scale = x.mean(0).astype(float), x.std(0).astype(float)
    d = 1 + 2 * pu_quality.N_FEATURES
    ridge = np.full(d, 0.01)

    def direct(w, prior):
        f = pu_quality.Model(mean, scale, w, prior).margin(x.astype(float))
        on_good = np.logaddexp(0, -f[good]).mean()
        bad = np.logaddexp(0, f).mean() - prior * np.logaddexp(0, f[good]).mean()
        return prior * on_good + max(0.0, bad) + 0.5 * (ridge * w**2).sum(), bad

    clamped = set()
    for scale_of, prior in ((0.1, 0.5), (3.0, 0.95), (0.3, 0.98)):
        w = rng.normal(size=d) * scale_of
        w[1] += 4 if prior > 0.9 else 0
        w[0] -= 6 if prior > 0.9 else 0
        model = pu_quality.Model(mean, scale, w, prior)
        value, slope, _ = pu_quality.risk(model, pu_quality._pass(table, model), ridge)
        expected, bad = direct(w, prior)
        clamped.add(bad < 0)
        assert value == pytest.approx(expected, rel=1e-6)
        for i in (0, 1, 7, 50):
            step = np.zeros(d)
            step[i] = 1e-5
            assert slope[i] == pytest.approx((direct(w + step, prior)[0] - direct(w - step, prior)[0]) / 2e-5, rel=1e-3, abs=1e-5)
    assert clamped == {True, False}, "both sides of the clamp are tested"


def test_toxicity_scores_by_plain_noisy_or(spark):
    ship_package(spark)
    docs = [(i, "A calm day. You rotten fool! Bread and milk." if i % 2 else "A calm day. The rotten apple fell. Bread and milk.") for i in range(400)]
    df = spark.createDataFrame(docs + [(500, None), (501, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = [(i, i % 2) for i in range(400)] + [(i, 0) for i in range(1, 40, 2)]  # twenty documents have both labels: toxic
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = mil_toxicity.train(df, known)
    got = {r["doc_id"]: r["score"] for r in mil_toxicity.scored(df, known).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(400))
    for i in (0, 1, 500):
        clean = 1.0
        for _, part in mil_toxicity.sentences((dict(docs).get(i) or "").encode()):
            known_words = {w for w in mil_toxicity.features(set(mil_toxicity._WORD.findall(part.lower()))) if w in model.words}
            clean *= 1 - 1 / (1 + math.exp(-(model.intercept + sum(model.weights[model.words[w]] for w in known_words))))
        assert got[i] == pytest.approx(1 - clean, abs=1e-9)


def test_language_fusion_by_plain_python(spark):
    ship_package(spark)
    docs = spark.createDataFrame([("the house and the river " * 3, "en"), ("das haus und der fluss " * 3, "de"), (None, "en")], "text string, lang string")
    made = []
    for i in range(24):
        host = ("one.example.org", "two.example.org", "three.test")[i % 3]
        words = "the river and the house" if i % 3 != 1 else "das haus und der fluss"
        made.append((i, f"https://{host}/{i}", f'<html lang="{"en" if i % 3 != 1 else "de"}">{words if i % 4 else ""}</html>'))
    made += [(100, None, None), (101, "no address", "<p>the house</p>")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = {r["page_id"]: (r["lang"], r["confidence"]) for r in langid.identify(pages, docs).collect()}

    names, logs = langid.profiles(docs)
    k, text, declared, where = len(names), {}, {}, {}
    for i, url, html in made:
        raw = (html or "").encode()
        grams = langid.trigrams(langid.visible_text(raw))
        weight = langid.TEMPER * langid.FULL_TEXT * math.log1p(len(grams) / langid.FULL_TEXT)
        text[i] = weight * logs[:, grams].mean(axis=1) if len(grams) else np.zeros(k)
        code = langid.declared_language(raw)
        declared[i] = "none" if code is None else code.decode() if code.decode() in names else "other"
        host = url.split("://")[1].split("/")[0] if url and "://" in url else ""
        where[i] = (host, ".".join(host.split(".")[-2:]), host.split(".")[-1])
    share = {i: np.exp(t - t.max()) / np.exp(t - t.max()).sum() for i, t in text.items()}
    total = sum(share.values())
    for i in text:
        own = share[i]
        markup = np.log((sum(share[j] for j in text if declared[j] == declared[i]) - own + 1) / (total - own + k + 2))
        belief = (total - own + 1) / (total.sum() - 1 + k)
        for level in (2, 1, 0):
            others = sum(share[j] for j in text if where[j][level] == where[i][level]) - own
            belief = (others + langid.SMOOTHING * belief) / (others.sum() + langid.SMOOTHING)
        fused = text[i] + markup + np.log(belief)
        chance = np.exp(fused - fused.max())
        assert got[i][0] == names[int(fused.argmax())]
        assert got[i][1] == pytest.approx(1 / chance.sum(), rel=1e-4)


def test_evidence_of_longer_texts_keeps_growing(spark):
    ship_package(spark)
    docs = spark.createDataFrame([("the house and the river " * 3, "en"), ("das haus und der fluss " * 3, "de")], "text string, lang string")
    names, logs = langid.profiles(docs)
    pages = spark.createDataFrame([(i, "https://a.example/", "the river " * n) for i, n in enumerate((50, 500, 5000))], "page_id long, url string, html string")
    found = {r["page_id"]: r["l0"] for r in langid.text_evidence(pages, names, logs).collect()}
    assert names[0] == "de" and found[0] > found[1] > found[2]


def test_passages_of_rows_without_or_with_repeated_ids(spark):
    def words(name, n=25):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(None, words("a")), (None, words("b") + " " + words("a", 22)), (None, None), (3, words("b")), (3, words("b")), (4, "x " + words("b"))]
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    # two rows without an id are documents of their own, the one that comes first by the hash of its text keeps the passage
    without = {n: gone for i, n, gone in got if i is None}
    assert sorted(without) == [0, 25, 47] and without[0] == 0
    assert (without[25], without[47]) in {(22, 0), (0, 22)}
    assert sorted(x for x in got if x[0] is not None) == [(3, 25, 25), (3, 25, 25), (4, 26, 25)]


def test_passage_in_a_third_of_all_rows(spark):
    common = " ".join(f"common{i}" for i in range(60))
    rows = [(i, " ".join(f"own{i}_{k}" for k in range(40)) + (" " + common + f" end{i}" if i % 3 == 0 else "")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    known = substring_dedup.judged(staging.staged(substring_dedup.cells(df.withColumn("doc", F.col("doc_id"))), "t_cells"))
    assert known.filter("anchor IS NULL").count() > 0 and known.filter("anchor IS NOT NULL").count() > 0
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {i: 60 if i and i % 3 == 0 else 0 for i in range(900)}

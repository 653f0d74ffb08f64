"""The learned and fuzzy operators: brute force where there is one, held-out labels where there isn't."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import image_copies, langid, line_dedup, mil_toxicity, pu_quality  # noqa: E402
from tessera.llm.queries import table  # noqa: E402

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_lines_match_brute_force(spark):
    docs = table(spark, SMALL, "documents").limit(120)
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "\n\nab\nAB \nab."), (9004, "x" * 5000), (9005, "x" * 4990 + "yyyyyyyyyy")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    places: dict[str, list] = {}
    for r in docs.collect():
        for i, line in enumerate((r["text"] or "").split("\n")):
            places.setdefault(line.strip(" ").lower(), []).append((r["doc_id"], i))
    keys = [k for k in places if k]
    sets = [{k[i : i + line_dedup.SHINGLE] for i in range(max(1, len(k) - line_dedup.SHINGLE + 1))} for k in keys]
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    roots = list(range(len(keys)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                roots[find(i)] = find(j)
    first: dict[int, tuple] = {}
    for i, k in enumerate(keys):
        first[find(i)] = min([first.get(find(i), (1 << 60, 0)), *places[k]])
    expected = {p: first[find(i)] for i, k in enumerate(keys) for p in places[k]}
    expected |= {p: p for p in places.get("", [])}
    got = {(r["doc_id"], r["line_no"]): ((r["first_doc_id"], r["first_line_no"]), r["kept"]) for r in line_dedup.deduplicate_lines(docs).collect()}
    assert {p: f for p, (f, _) in got.items()} == expected
    assert all(kept == (p == f) for p, (f, kept) in got.items())


def test_kept_text_of_lines(spark):
    docs = spark.createDataFrame([(1, "one line that is long enough\ntwo"), (2, "one line that is long enough!\nthree"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.kept_text(docs).collect()}
    assert got == {1: "one line that is long enough\ntwo", 2: "three", 3: ""}


def _held_out_labels(spark, column):
    rows = table(spark, SF, "labels").select("doc_id", column).collect()
    return {r["doc_id"]: r[column] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def _auc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_labels(spark):
    docs = table(spark, SF, "documents")
    awkward = spark.createDataFrame([(None, "no id"), (90001, None), (90002, ""), (90003, "word " * 30000)], "doc_id long, text string")
    rows = pu_quality.scored(docs.select("doc_id", "text").union(awkward), table(spark, SF, "labels")).collect()
    assert len(rows) == docs.count() + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = _held_out_labels(spark, "quality")
    found = {r["doc_id"]: r for r in rows}
    assert _auc([(found[i]["score"], y) for i, y in truth.items()]) > 0.95
    assert np.mean([found[i]["predicted"] == y for i, y in truth.items()]) > 0.85


def test_quality_without_labels_or_documents(spark):
    docs = table(spark, SMALL, "documents")
    none = table(spark, SMALL, "labels").limit(0)
    rows = pu_quality.scored(docs, none).collect()
    assert {r["score"] for r in rows} == {pu_quality.PRIOR_DEFAULT}
    assert pu_quality.scored(docs.limit(0), table(spark, SMALL, "labels")).count() == 0
    assert pu_quality.keep_good(docs, table(spark, SMALL, "labels")).columns == docs.columns


def test_number_of_features():
    for text in (b"", b" ", b"a", b"Some text, here.\nAnd a line", "éè 中文".encode()):
        x = pu_quality.features(text)
        assert len(x) == pu_quality.N_FEATURES and np.isfinite(x).all()


def test_features_see_whole_texts_and_lines():
    rng = np.random.default_rng(1)
    noise = bytes(rng.integers(97, 123, 200_000).astype(np.uint8))
    junk = b"junk " * 40_000
    packed = [pu_quality.features(t)[27] for t in (noise, noise + junk, junk + noise, junk)]
    assert packed[0] > 1.5 * packed[1] and packed[2] > 10 * packed[3] and abs(packed[1] - packed[2]) < 0.05
    for text in (b"a few words", noise[:70_000], junk):
        assert pu_quality.packed_size(text) == len(zlib.compress(text, 1))
    assert pu_quality.features(b"One line." + b" " * 20 + b"\nTwo lines!\t\r\nthree")[24] == pytest.approx(2 / 3)


def test_prior_from_unlabelled_documents(spark):
    """Without labelled bad documents the share of good ones is found from good and all documents."""
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    features = pu_quality.document_features(docs)
    good = labels.filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    data = features.join(good, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False))).persist()
    model = pu_quality.train(data)
    assert 0.7 < model.prior < 0.95
    data.unpersist()


def test_toxicity_on_held_out_labels(spark):
    docs = table(spark, SF, "documents")
    awkward = spark.createDataFrame([(None, "you idiot"), (90001, None), (90002, "")], "doc_id long, text string")
    rows = mil_toxicity.scored(docs.select("doc_id", "text").union(awkward), table(spark, SF, "labels")).collect()
    assert len(rows) == docs.count() + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    truth = _held_out_labels(spark, "toxic")
    found = {r["doc_id"]: r for r in rows}
    assert _auc([(found[i]["score"], y) for i, y in truth.items()]) > 0.7
    clean = [i for i, y in truth.items() if y == 0]
    assert np.mean([found[i]["predicted"] for i in clean]) < 0.05


def test_toxic_sentences_are_located(spark):
    """One offending sentence in a clean text: learned from labels of whole documents."""
    import random

    rng = random.Random(2)
    clean = lambda: " ".join(rng.choice(["tree", "house", "river", "stone", "cloud", "meadow"]) for _ in range(6)).capitalize() + "."
    rows, labels = [], []
    for i in range(600):
        parts = [clean() for _ in range(5)]
        if i % 5 == 0:
            parts[2] = "You " + rng.choice(["grobian", "lummox"]) + " there."
        rows.append((i, " ".join(parts)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = mil_toxicity.scored(docs, known).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in got)
    text = dict(rows)
    for r in got:
        if r["predicted"]:
            assert "You" in text[r["doc_id"]][r["sentence_start"] : r["sentence_start"] + r["sentence_length"]]
    found = mil_toxicity.offending_sentences(docs, known).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(600) if i % 5 == 0} and all("You" in r["sentence"] for r in found)


def test_bag_gradient_is_the_slope_of_the_loss(spark):
    model = mil_toxicity.Model({b"bad": 0, b"ugly": 1}, np.zeros(2), -2.0, None)
    docs = spark.createDataFrame([(1, "bad day. fine day."), (0, "ugly day"), (1, "bad ugly. ugly. nice"), (0, "plain")], "toxic int, text string")
    bags = mil_toxicity.bags(docs, model).persist()
    w, b, eps = np.array([0.3, -0.2]), -1.0, 1e-5
    g = mil_toxicity.gradient(bags, w, b)
    for i in range(2):
        step = np.eye(2)[i] * eps
        slope = (mil_toxicity.gradient(bags, w + step, b)[-2] - mil_toxicity.gradient(bags, w - step, b)[-2]) / (2 * eps)
        assert g[i] == pytest.approx(slope, rel=1e-4)
    slope = (mil_toxicity.gradient(bags, w, b + eps)[-2] - mil_toxicity.gradient(bags, w, b - eps)[-2]) / (2 * eps)
    assert g[2] == pytest.approx(slope, rel=1e-4)
    bags.unpersist()


def test_toxicity_without_labels(spark):
    docs = table(spark, SMALL, "documents").limit(20)
    none = table(spark, SMALL, "labels").limit(0)
    assert {r["score"] for r in mil_toxicity.scored(docs, none).collect()} == {0.0}
    assert mil_toxicity.scored(docs.limit(0), none).count() == 0


def test_language_of_pages(spark):
    pages, docs = table(spark, SF, "pages"), table(spark, SF, "documents")
    awkward = spark.createDataFrame([(90001, None, None), (90002, "not a url", ""), (None, "http://x.example.de/", "<html lang='xx'>")], "page_id long, url string, html string")
    rows = langid.identify(pages.select("page_id", "url", "html").union(awkward), docs).collect()
    assert len(rows) == pages.count() + 3
    path = {r["page_id"]: r["url"].split("/")[3] for r in pages.collect()}
    right = [r["lang"] == path[r["page_id"]] for r in rows if r["page_id"] in path and path[r["page_id"]] in ("en", "de", "fr", "es")]
    assert len(right) > 100 and np.mean(right) > 0.98
    assert all(0 <= r["confidence"] <= 1 for r in rows)
    assert langid.identify(pages.limit(0), docs).count() == 0 and langid.identify(pages, docs.limit(0)).count() == 0


def test_declared_language_anywhere_in_the_page(spark):
    far = "<!-- " + "server output " * 1000 + "-->" + " " * 5000 + "<HTML class=x\nLang = 'DE-at'><p>der hund"
    docs = spark.createDataFrame([("the cat sat on the mat " * 5, "en"), ("der hund und die katze " * 5, "de")], "text string, lang string")
    pages = spark.createDataFrame([(1, None, far), (2, None, "<p>the cat"), (3, None, "<html><script>'<html lang=de>'</script><!-- <html lang=de> --><p>the cat")], "page_id long, url string, html string")
    assert {r["page_id"]: r["declared"] for r in langid.identify(pages, docs).collect()} == {1: "de", 2: "none", 3: "none"}
    for awkward in (b"<!--" * 300_000, b"<script>" * 200_000, b"<html " * 200_000, b"<html lang=" + b" " * 1_000_000, b"<html " + b"lang " * 200_000):
        assert langid.declared_language(awkward) is None
    assert langid.declared_language(b"<!--><html><html lang=fr>") == b"fr"


def test_host_prior_decides_where_text_is_silent(spark):
    docs = spark.createDataFrame([("the cat sat on the mat and then the dog ran " * 5, "en"), ("der hund und die katze sind auf der matte " * 5, "de")], "text string, lang string")
    rows = [(i, "http://a.example.org/x", "<p>der hund und die katze sind auf der matte") for i in range(20)] + [(i, "http://b.example.org/x", "<p>the cat sat on the mat and then the dog") for i in range(20, 40)]
    rows += [(100, "http://a.example.org/y", "<p>42"), (101, "http://b.example.org/y", "<p>42"), (102, None, "<html lang=de><p>42")]
    got = {r["page_id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[100] == "de" and got[101] == "en"
    assert all(got[i] == ("de" if i < 20 else "en") for i in range(40))


def test_image_copies(spark):
    vectors = table(spark, SF, "embeddings")
    media = image_copies.media_table(vectors)
    same = media.filter("media_id = 8").select((F.col("media_id") + 900_001).alias("media_id"), "width", "height", "pixels")
    broken = spark.createDataFrame([(None, 2, 2, b"abcd"), (950_000, 2, 2, None), (950_001, 3, 3, b"ab"), (950_002, 2, 2, b"abcd")], "media_id long, width int, height int, pixels binary")
    rows = image_copies.find_copies(media.union(same).union(broken), (F.col("media_id") % 20 == 0) | (F.col("media_id") == 8)).collect()
    pairs = {(r["query_id"], r["media_id"]) for r in rows if not r["same_pixels"]}
    assert {(r["query_id"], r["media_id"]) for r in rows if r["same_pixels"]} == {(8, 900_009)}
    assert all(r["inliers"] >= image_copies.INLIERS for r in rows if not r["same_pixels"])
    ids = [r["vec_id"] for r in vectors.select("vec_id").collect() if r["vec_id"] % 5 == 0]
    planted = {(4 * v, 4 * v + (v + 1) % 4) for v in [2, *ids] if (v + 1) % 4}
    assert len(planted & pairs) >= 0.95 * len(planted)
    assert len(pairs - planted) <= 0.02 * len(planted)
    assert image_copies.find_copies(media.limit(0), F.lit(True)).count() == 0

"""Rows and pages that once took time with the square of their number, and indexes and images in awkward states."""

from __future__ import annotations

import random
import re
import time
import uuid

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import exact_dedup, image_copies, langid, line_dedup, queries, substring_dedup  # noqa: E402
from tessera.llm.queries import table  # noqa: E402
from tessera.session import ship_package  # noqa: E402

#: What is hidden, as one pattern; it searches to the end of a page from everything left open.
HIDDEN = re.compile(rb"<(script|style|nav|aside|footer|header|noscript)\b.*?</\1\s*>|<!--.*?-->|<div[^>]*class=\"?ad\b.*?</div>|<[^>]*>|&[a-z#0-9]+;", re.I | re.S)
PARTS = [b"<script>", b"</script>", b"</SCRIPT  >", b"<nav", b"</nav>", b"<!--", b"-->", b"<div class=ad>", b"<div ", b'class="ad" ', b"class=ad", b"</div>", b"<", b">"]
PARTS += [b"&amp;", b"&x", b";", b"a ", b"\n", b"<p>", b"<divx", b"<headerx>", b"<style>", b"</style", b"class=adx", b"<!-", b"--"]


def test_visible_text_is_that_of_the_pattern():
    rng = random.Random(9)
    for _ in range(20_000):
        html = b"".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert langid.visible_text(html) == HIDDEN.sub(b" ", html), html


@pytest.mark.parametrize("part", [b"<nav>", b"<script>", b"<!--", b"<div class=ad>", b"<div ", b"<div class=ad ", b"<", b"&aaaa", b"</script "])
def test_open_tags_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    started = time.process_time()
    langid.visible_text(page)
    assert time.process_time() - started < 8


def test_many_equal_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = "start " + " ".join(f"w{i}" for i in range(10, 45)) + " end"
    docs = spark.createDataFrame([(7, text)] * 3000 + [(8, other)], "doc_id long, text string").repartition(4)
    started = time.time()
    rows = {(r["doc_id"], r["n_words"], r["n_removed"]): r["count"] for r in substring_dedup.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert rows == {(7, 60, 0): 3000, (8, 37, 35): 1}
    assert time.time() - started < 120


def test_index_is_found_by_a_later_session_and_takes_a_batch_twice(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    more = spark.createDataFrame([(9, "B"), (10, "c")], "doc_id long, text string")

    def taken(index, df, batch):
        return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["known"]) for r in index.ingest(df, batch).collect())

    index = exact_dedup.DigestIndex(spark, path, 4)
    first = taken(index, docs, "one")
    assert first == [(1, 2, 2, False, False), (2, 2, 2, True, False), (3, 3, 1, True, False)]
    assert taken(index, docs, "one") == first and index.read().count() == 2
    spark.sql(f"DROP TABLE {index.name}")
    later = exact_dedup.DigestIndex(spark.newSession(), path)
    assert taken(later, more, "two") == [(9, 3, 1, False, True), (10, 10, 1, True, False)]
    assert later.read().count() == 3
    assert sorted(r["kept"] for r in later.take_halves(docs, "one").collect()) == [False, True, True]
    later.drop()


def test_halves_are_decided_as_a_whole_against_an_older_batch(spark):
    index = exact_dedup.DigestIndex(spark, f"halves_{uuid.uuid4().hex}", 4)
    index.ingest(spark.createDataFrame([(50, "old")], "doc_id long, text string"), "old")
    docs = spark.createDataFrame([(1, "old"), (90, "old"), (2, "x"), (91, "X"), (3, "y"), (3, "y"), (None, "z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in index.take_halves(docs).collect()), key=repr)
    assert got == sorted([(1, 50, 2, False), (90, 50, 2, False), (2, 91, 2, False), (91, 91, 2, True), (3, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)], key=repr)
    index.drop()


SIZES = "media_id long, width int, height int, pixels binary"


def pixels(image):
    return bytearray(np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes())


def test_images_whose_sizes_do_not_fit_are_left_out(spark):
    ship_package(spark)
    image = image_copies.picture(np.array([0.5, 1.5]))
    rows = [(100, 80, 80, pixels(image)), (1, 80, 80, pixels(image))]
    rows += [(2, 100_000, 100_000, b"a"), (3, -2, -2, b"abcd"), (4, 0, 0, b""), (5, None, 4, b"abcd"), (6, 2**31 - 1, 2**31 - 1, b"ab"), (7, 1, 4, b"abcd"), (8, 4, 1, b"abcd")]
    media = spark.createDataFrame(rows, SIZES)
    found = [(r["query_id"], r["media_id"], r["inliers"], r["same_pixels"]) for r in image_copies.find_copies(media, F.col("media_id") == 100).collect()]
    assert found == [(1, 100, None, True)], "a class goes by its smallest id; equal bytes of other sizes are other pictures"
    assert image_copies.find_copies(media, F.lit(None).cast("boolean")).count() == 0


def test_ids_with_several_pictures_and_pictures_with_several_ids(spark):
    ship_package(spark)
    one, two = (image_copies.picture(np.array([i + 0.5, 2.0])) for i in range(2))
    rows = [(100, 80, 80, pixels(one)), (9, 80, 80, pixels(two)), (9, 64, 62, pixels(one[5:67, 3:67])), (10, 64, 62, pixels(one[5:67, 3:67])), (11, 64, 62, pixels(one[5:67, 3:67]))]
    found = {(r["query_id"], r["media_id"]) for r in image_copies.find_copies(spark.createDataFrame(rows, SIZES).repartition(3), F.col("media_id") == 100).collect()}
    assert found == {(100, 9), (100, 10), (100, 11)}


def test_pairs_do_not_depend_on_chunks_and_blocks(spark, monkeypatch):
    ship_package(spark)
    vectors = spark.createDataFrame([(i, [i + 0.25, 3.0 * i]) for i in range(40)], "vec_id long, embedding array<double>")
    media = image_copies.media_table(vectors).repartition(3)

    def pairs():
        return sorted(map(tuple, image_copies.find_copies(media, F.col("media_id") % 20 == 0).collect()))

    whole = pairs()
    assert len(whole) >= 6
    for name, value in (("CHUNK", 700), ("BLOCK", 300), ("PAIRS_AT_ONCE", 50), ("GROUP", 200)):
        monkeypatch.setattr(image_copies, name, value)
    assert pairs() == whole


def test_a_descriptor_that_all_corners_have(spark):
    """Flat stripes look alike everywhere; the work is divided, and nothing is lost of the pictures beside them."""
    ship_package(spark)
    stripes = np.tile(np.repeat([30.0, 220.0], 8), 10)[None].repeat(160, 0)
    stripes = np.where(np.arange(160)[:, None] // 8 % 2 == 0, stripes, 250 - stripes)
    one = image_copies.picture(np.array([4.5, 2.0]))
    rows = [(i, 160, 160, pixels(np.roll(stripes, i % 16, 1) + i)) for i in range(8)] + [(100, 80, 80, pixels(one)), (101, 64, 62, pixels(one[5:67, 3:67]))]
    found = {(r["query_id"], r["media_id"]) for r in image_copies.find_copies(spark.createDataFrame(rows, SIZES), F.col("media_id") % 100 == 0).collect()}
    assert (100, 101) in found and not found & {(100, i) for i in range(8)}


def test_few_corners_of_other_pictures_are_compared():
    """Corners are alike in many tests, so words are shared by many; tests that go together are in different words."""
    rng = np.random.default_rng(11)
    corners = np.concatenate([image_copies._corners(i, np.rint(image_copies.picture(rng.normal(size=8))).astype(np.uint8)) for i in range(120)])
    half = int(np.flatnonzero(corners["corner"] == 0)[60])
    asked, rows = corners[:half], corners[half:]
    tables = image_copies.Tables(asked)
    # by brute force
    apart = sum(np.bitwise_count(rows[h][:, None] ^ asked[h][None]) for h in ("h0", "h1"))
    expected = set(zip(*(x.tolist() for x in np.nonzero(apart <= image_copies.MOST_BITS)), strict=True))
    found = [pair for m, q in tables.near(rows) for pair in zip(m.tolist(), q.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected
    # corners whose words differ in one bit at most are compared, and words part corners well
    met = [tables.parts[part][0] for part in range(image_copies.WORDS)]
    words = [image_copies._word(rows["h0"], rows["h1"], part) for part in range(image_copies.WORDS)]
    candidates = sum(int((starts[w + 1] - starts[w]).sum()) for starts, w in zip(met, words, strict=True))
    assert candidates < 0.018 * len(rows) * len(asked)


def test_matches_that_are_too_many_to_hold_are_found_in_halves(monkeypatch):
    rng = np.random.default_rng(12)
    images = [image_copies.picture(rng.normal(size=8)) for _ in range(12)]
    corners = [image_copies._corners(i, np.rint(im).astype(np.uint8)) for i, im in enumerate([*images, *(im[4:66, 7:71] for im in images)])]
    tables, rows = image_copies.Tables(np.concatenate(corners[:12])), np.concatenate(corners)

    def found():
        return sorted(row for part in image_copies.agreed(rows, tables, image_copies.INLIERS) for row in zip(*(c.tolist() for c in part), strict=True))

    whole = found()
    assert {(i, i + 12) for i in range(12)} <= {row[:2] for row in whole}
    for name, value in (("MATCHES_HELD", 5), ("GROUP", 1), ("FREQUENT", 1), ("PAIRS_AT_ONCE", 7)):
        monkeypatch.setattr(image_copies, name, value)
    assert found() == whole


def test_vectors_of_one_file_are_dealt_to_many_tasks(spark, monkeypatch, tmp_path):
    """Pictures take long to describe, and a table of few bytes is few partitions."""
    rows = [(i, [i + 0.25, 3.0 * i]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(queries, "VECTORS_A_TASK", 10, raising=False)
    seen = []
    whole = image_copies.copies_among
    monkeypatch.setattr(image_copies, "copies_among", lambda images: seen.append(images.filter("image IS NOT NULL").select(F.shiftright("image", 33)).distinct().count()) or whole(images))
    found = sorted(map(tuple, queries.op4_image_copies(spark, str(tmp_path)).collect()))
    assert seen == [3]
    media = image_copies.media_table(table(spark, str(tmp_path), "embeddings"))
    assert found == sorted(map(tuple, image_copies.find_copies(media, F.col("media_id") % 100 == 0).collect())) and found


def test_pictures_described_together_are_described_as_each_alone(monkeypatch):
    rng = np.random.default_rng(13)
    images = [image_copies.picture(rng.normal(size=8)) for _ in range(7)]
    images = [np.rint(image).astype(np.uint8) for image in [*images, *(im[4:66, 7:71] for im in images), images[0][:3, :5], images[1][:26, :30], np.zeros((80, 80)), *images[:3]]]
    for pixels_at_once in (1, 20_000, 1_000_000):
        monkeypatch.setattr(image_copies, "TOGETHER", pixels_at_once)
        together = list(image_copies._corners_of(list(range(len(images))), images))
        assert all(np.array_equal(image_copies._corners(i, image), got) for i, (image, got) in enumerate(zip(images, together, strict=True)))
    assert min(len(together[i]) for i in range(7)) > 50


def test_tables_hold_a_corner_once_a_word(monkeypatch):
    """Corners look up the neighbours of their words, so that a block can have many, and what is met is compared half by half."""
    rng = np.random.default_rng(14)
    corners = np.concatenate([image_copies._corners(i, np.rint(image_copies.picture(rng.normal(size=8))).astype(np.uint8)) for i in range(40)])
    half = int(np.flatnonzero(corners["corner"] == 0)[20])
    tables, rows = image_copies.Tables(corners[:half]), corners[half:]
    assert sum(len(order) for _, order in tables.parts) == image_copies.WORDS * half
    apart = [np.bitwise_count(rows[h][:, None] ^ corners[:half][h][None]) for h in ("h0", "h1")]
    halves = [np.ascontiguousarray(rows[h]) for h in ("h0", "h1")]
    for frequent in (1, 16, 1 << 40):
        monkeypatch.setattr(image_copies, "FREQUENT", frequent)
        for part in range(image_copies.WORDS):
            words = [image_copies._word(x["h0"], x["h1"], part) for x in (rows, corners[:half])]
            near = (np.bitwise_count(words[0][:, None] ^ words[1][None]) <= 1) & (apart[part // 3] <= 5) & (apart[0] + apart[1] <= image_copies.MOST_BITS)
            met = [pair for m, q, *_ in tables._met(halves, part) for pair in zip(m.tolist(), q.tolist(), strict=True)]
            assert sorted(met) == sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_lines_that_are_like_no_other_are_not_moved(spark):
    keyed = spark.range(-3000, 3000).select(F.xxhash64("id").alias("k1"), "id")
    keys = keyed.filter("id % 10 = 0").select("k1")
    left = {r["id"] for r in line_dedup.likely(keyed, keys.union(keys)).collect()}
    assert {i for i in range(-3000, 3000) if i % 10 == 0} <= left and len(left) < 610
    assert line_dedup.likely(keyed, keys.limit(0)).count() == 0


def test_one_bit_of_the_bitmap_is_one_key(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEEN_BITS", 1 << 16)
    keyed = spark.range(1 << 16).select(F.col("id").alias("k1"))
    keys = keyed.filter("k1 % 7 = 3 OR k1 > 65520")
    assert sorted(r["k1"] for r in line_dedup.likely(keyed, keys).collect()) == [i for i in range(1 << 16) if i % 7 == 3 or i > 65520]


def test_near_misses_make_few_pairs(spark, monkeypatch):
    """A family of lines that are alike, but less than 0.8, is parted by sketches; the pairs of it that are similar are found."""
    rng = np.random.default_rng(13)

    def word():
        return "".join(rng.choice(list("abcdefghij"), 6))

    base = [word() for _ in range(60)]
    family = [[word() if i in gone else w for i, w in enumerate(base)] for gone in (set(rng.choice(60, 4, replace=False).tolist()) for _ in range(150))]
    # of some there is a copy with another last word
    rows = [" ".join(f) for f in family] + [" ".join([*f[:-1], word()]) for f in family[:20]]
    sets = [{r[i : i + line_dedup.SHINGLE] for i in range(len(r) - line_dedup.SHINGLE + 1)} for r in rows]
    similar = {(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    alike = sum(2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j]) for i in range(150) for j in range(i))
    assert 20 <= len(similar) < 200 and alike > 8000, "nearly all pairs are near misses"
    written, real = {}, line_dedup.staged

    def noted(df, name):
        out = real(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "staged", noted)
    got = line_dedup.deduplicate_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    firsts = {r["doc_id"]: r["first_doc_id"] for r in got}
    assert all(firsts[i] == firsts[j] for i, j in similar) and len(set(firsts.values())) >= len(rows) - len(similar)
    assert written["first"] + written["rest"] < 1000


def test_sketches_keep_all_similar_lines(spark):
    rng = np.random.default_rng(14)
    base = "".join(rng.choice(list("abcdefgh "), 400))
    rows = [base[i : i + n] for i, n in ((0, 400), (0, 322), (78, 322), (0, 330), (20, 360), (0, 5), (0, 8), (0, 9), (3, 200), (0, 200))] + ["é" * 40, "é" * 50]
    sets = [{r[i : i + line_dedup.SHINGLE] for i in range(max(1, len(r) - line_dedup.SHINGLE + 1))} for r in rows]
    texts = spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "k1 long, k2 long, line string")
    drawn = line_dedup.sketches(texts)
    pairs = line_dedup._side(drawn, "a").crossJoin(line_dedup._side(drawn, "b")).filter(line_dedup._may_be_similar()).select("a1", "b1").collect()
    left = {(r["a1"], r["b1"]) for r in pairs}
    similar = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert similar <= left and len(left) < len(rows) ** 2 / 2
    assert {r["k1"]: set(r["shingles"]).__len__() for r in line_dedup.shingle_sets(texts).collect()} == {i: len(s) for i, s in enumerate(sets)}

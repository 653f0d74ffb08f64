"""Spelling variants against brute force and SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from tessera.llm import spelling  # noqa: E402
from tessera.llm.queries import SQL, op11_spelling_variants  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants(df):
    return sorted(tuple(r) for r in spelling.variants(df).select(COLUMNS).collect())


def misspelt(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abeéÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeÉéßÀ") for _ in range(rng.randrange(5, 11))) for _ in range(60)] + ["a" * 300, "b" * 300 + "c"]
    out = []
    for i in range(150):
        words = []
        for _ in range(60):
            word = stems[min(int(rng.expovariate(0.1)), len(stems) - 1)]
            words.append(misspelt(rng, word) if rng.random() < 0.5 else word)
        out.append((i, rng.choice([" ", ", ", "-", "1"]).join(words)))
    return [*out, (None, "Strasse " * 30), (None, None), (1, ""), (2, "× " * 9), (3, "anagram " * 9 + "nagaram " * 9 + "aaaaaa " * 60 + "AAAAAB " * 12 + "aaaabb " * 6)]


def test_variants_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_variants(rows)
    assert sum(r[1] is not None for r in expected) > 20
    assert variants(docs) == expected


def test_cells_do_not_change_what_is_found(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = variants(docs)
    monkeypatch.setattr(spelling, "CELL_WORDS", 10)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 100)
    monkeypatch.setattr(spelling, "VISITORS", 3)
    assert variants(docs) == whole


def test_cells_part_space_and_are_found_within_their_distance():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (500, 6))
    root = spelling.cell_tree(points, 20)
    homes = np.full(500, -1)
    for leaf, rows in spelling.near_leaves(root, points, 0):
        assert (homes[rows] == -1).all()
        homes[rows] = leaf.leaf
    assert (homes >= 0).all() and len(set(homes.tolist())) > 10
    visited = {(leaf.leaf, int(r)) for leaf, rows in spelling.near_leaves(root, points, 2) for r in rows}
    close = np.abs(points[:, None] - points[None]).sum(2) <= 2
    assert all((int(homes[j]), int(i)) in visited for i, j in zip(*np.nonzero(close), strict=True))
    assert len(visited) < 500 * len(set(homes.tolist()))


def test_long_chains_are_followed(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("x", "w05")], "word string, up string")
    assert {r["up"] for r in spelling.followed(links).collect()} == {"w20"}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "strasse " * 3, 1, "q") for i in range(4)], "doc_id long, text string, n long, word string")
    assert variants(docs) == brute_variants([(i, "strasse " * 3) for i in range(4)])
    assert variants(docs.limit(0)) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.sql(SQL["op11_spelling_variants"]).select(*COLUMNS).fetchall()
    df = op11_spelling_variants(spark, SF)
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect()), key=str) == sorted(found, key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(found) == brute_variants([tuple(r) for r in docs])

"""The Merkle manifest against SQL and a plain recursive version."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import merkle  # noqa: E402
from tessera.llm.queries import SQL, op13_merkle  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    fields = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, place, value):
    found = []
    for level in tree[:-1]:
        other = place ^ 1
        if other < len(level):
            found.append(level[other])
            value = digest([value, level[other]] if place % 2 == 0 else [level[other], value])
        else:
            value = digest([value])
        place //= 2
    return found, value


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, sorted_rows = {}, {}
    for g in order:
        sorted_rows[g] = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in sorted_rows[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for place, r in enumerate(sorted_rows[g]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            low, value = climb(trees[g], place, leaf(r, int(changed)))
            high, value = climb(top, at, value)
            root = top[-1][0]
            out.append((str(r["doc_id"]), leaf(r), trees[g][-1][0], root, digest(low + high), value, value == root))
    return sorted(out)


def manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in merkle.documents_manifest(docs, tampered).collect())


def test_van_emde_boas_places():
    for n in range(1, 10):
        at = merkle.places(n)
        assert [len(x) for x in at] == [2**d for d in range(n)]
        assert sorted(np.concatenate(at).tolist()) == list(range(2**n - 1))
    # four levels: the upper two levels, then four subtrees of three nodes
    assert [x.tolist() for x in merkle.places(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_paths_of_a_block_give_its_root(n):
    leaves = [sha256(bytes([i])).digest() for i in range(n)]
    block = merkle.Block.built(leaves, (n - 1).bit_length())
    assert block.root.hex() == levels([x.hex() for x in leaves])[-1][0]
    assert all(merkle.folded(x, block.path(i)) == block.root for i, x in enumerate(leaves))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", height)
    rows = [(i, f"text {i}" * (i % 3), ["en", "de", "fr"][min(i % 7, 2)], f"s{i % 2}", i) for i in range(45)]
    rows += [(None, None, None, None, None), (None, "", None, "x", 2**63 - 1), (7, "text 7", "en", "s1", 7), (7, "text 7", "en", "s1", 7), (50, "é" * 5000, "", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert manifest(docs) == brute_manifest(docs.collect())


def test_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    assert manifest(docs) == brute_manifest(docs.collect())
    assert manifest(docs.limit(0)) == []


def test_further_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a", "en", "s", 1) for i in range(5)], SCHEMA)
    wide = docs.withColumns({c: F.lit("x") for c in ("tree", "digest", "offered", "row", "place", "n", "group", "leaf")})
    assert manifest(wide) == manifest(docs)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.sql(SQL["op13_merkle"])
    df = op13_merkle(spark, SF)
    assert df.columns == found.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())

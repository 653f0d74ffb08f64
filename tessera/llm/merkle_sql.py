"""The Merkle manifest of ``documents`` as recursive SQL: levels are made upwards, then each row is folded upwards."""

from __future__ import annotations

from .crc_sql import CRC_STEPS, sql_crc32


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _row_digest(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, start: str) -> str:
    """All nodes of trees: tree, level, place, h, n (nodes of the level)."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2, n)"""


def _climb(name: str, start: str, nodes: str) -> str:
    """Rows carried to the root of their tree: id, tree, level, place, cur (the folded digest), sib (siblings so far)."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.place // 2,
         sha256(CASE WHEN s.h IS NULL THEN f.cur WHEN f.place % 2 = 0 THEN f.cur || s.h ELSE s.h || f.cur END), f.sib || coalesce(s.h, '')
  FROM {name} f JOIN {nodes} o ON o.tree = f.tree AND o.level = f.level AND o.place = f.place AND o.n > 1
  LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1))"""


def manifest_sql(divisor: int) -> str:
    base = f"""base AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('+' || lang, '') AS tree, {_row_digest('n_chars')} AS leaf,
         coalesce({sql_crc32('doc_id::VARCHAR')} % {divisor} = 0, false) AS changed, {_row_digest('(n_chars::HUGEINT + 1)')} AS other
  FROM documents, crc_steps),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM base)"""
    parts = [
        CRC_STEPS,
        base,
        _levels("nodes", "SELECT tree, 0 AS level, place, leaf AS h, n FROM leaves"),
        "subroots AS (SELECT tree AS lang_tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1)",
        _levels("tops", "SELECT '' AS tree, 0 AS level, place, subroot AS h, n FROM subroots"),
        _climb("low", "SELECT id, tree, 0 AS level, place, CASE WHEN changed THEN other ELSE leaf END AS cur, '' AS sib FROM leaves", "nodes"),
        "low_ends AS (SELECT low.id, low.cur, low.sib, s.subroot, s.place FROM low JOIN nodes ON nodes.tree = low.tree AND nodes.level = low.level AND nodes.place = low.place AND nodes.n = 1 JOIN subroots s ON s.lang_tree = low.tree)",
        _climb("high", "SELECT id, '' AS tree, 0 AS level, place, cur, sib FROM low_ends", "tops"),
        "root AS (SELECT level AS top_level, h AS root FROM tops WHERE n = 1)",
    ]
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(high.sib) AS proof_sha256, high.cur AS folded_root, high.cur = root AS verified\n"
        "FROM high JOIN root ON high.level = top_level JOIN leaves USING (id) JOIN low_ends USING (id)"
    )

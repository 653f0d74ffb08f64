"""CRC-32 as SQL, for an engine that has no such function."""

from __future__ import annotations

#: The reversed generator polynomial of CRC-32 (IEEE 802.3), a fixed value.
POLYNOMIAL = 0xEDB88320

#: One row with the list ``steps``: what each of the 256 byte values adds.
CRC_STEPS = f"""crc_steps AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) r(i))"""


def sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; ``crc_steps`` must be among the relations of the query."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(0, len({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"

"""Expressions that DuckDB has no function for."""

from __future__ import annotations


def _table() -> list[int]:
    """The table of crc32, by its reflected polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text whose code points are below 0x800."""
    byte = "flatten(list_transform(string_split(%s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"
    step = f"lambda c, b: xor(c >> 8, (CAST({_table()} AS BIGINT[]))[CAST(xor(c & 255, b) AS INT) + 1])"
    return f"xor(list_reduce({byte % text}, {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"

"""CRC-32 in DuckDB SQL, half a byte at a time; the table follows from the polynomial."""

from __future__ import annotations


def _table() -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an expression's UTF-8 bytes."""
    halves = f"flatten(list_transform(range(0, octet_length(encode({text}))), lambda i: [substr(hex(encode({text})), 2 * i + 2, 1), substr(hex(encode({text})), 2 * i + 1, 1)]))"
    digits = f"list_transform({halves}, lambda d: CAST(strpos('0123456789ABCDEF', d) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, d: xor(c >> 4, (CAST({_table()} AS BIGINT[]))[(xor(c, d) & 15) + 1])), CAST(4294967295 AS BIGINT))"

"""SQL that several modules of queries use."""

from __future__ import annotations


def distance_sql(r: str, h: str) -> str:
    """The edit distance of two texts in characters, as a fold over those of ``h``."""
    inner = f"list_reduce(range(1, length({r}) + 1), lambda acc, j: list_append(acc, least(t[j + 1] + 1, acc[-1] + 1, t[j] + (substr({r}, j, 1) != c)::bigint)), [t[1] + 1])"
    return f"list_reduce(list_filter(string_split({h}, ''), lambda c: c != ''), lambda t, c: {inner}, range(0, length({r}) + 1))[-1]"


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce(range(0, 8), lambda x, i: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end), xor(x, ascii(c)::bigint))"
    return f"xor(list_reduce(list_filter(string_split({text}, ''), lambda c: c != ''), lambda x, c: {byte}, 4294967295::bigint), 4294967295::bigint)"

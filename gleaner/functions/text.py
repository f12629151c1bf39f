"""Column expressions over strings that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _width_pairs() -> tuple[str, str]:
    """Every character that is another width of one character, and that character."""
    odd, plain = [], []
    for code in (0x3000, *range(0xFF01, 0xFFEF)):
        tag, _, to = unicodedata.decomposition(chr(code)).partition(" ")
        if tag in ("<wide>", "<narrow>"):
            odd.append(chr(code)), plain.append(chr(int(to, 16)))
    return "".join(odd), "".join(plain)


WIDE, PLAIN = _width_pairs()
BLANK = "[\\s\\p{Z}\\x{0085}]"


def fold_width(text: Column) -> Column:
    """One width for every character; a voicing mark joins the half-width kana before it."""
    folded = F.translate(text, WIDE, PLAIN)
    joined = folded
    for code in (*range(0x30A6, 0x30FF),):
        for mark in "゙゚":
            whole = unicodedata.normalize("NFC", chr(code) + mark)
            if len(whole) == 1:
                joined = F.replace(joined, F.lit(chr(code) + mark), F.lit(whole))
    return F.when(text.rlike("[ﾞﾟ]"), joined).otherwise(folded)


def fold_name(text: Column) -> Column:
    """A name compared without regard to case, width or outer blanks."""
    return F.lower(F.regexp_replace(fold_width(text), f"^{BLANK}+|{BLANK}+$", ""))

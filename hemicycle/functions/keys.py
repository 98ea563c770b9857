"""Normal forms of names and keys."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accents() -> tuple[str, str]:
    """Characters with accents and their base letters, by Unicode decomposition of the Latin, Greek and Cyrillic blocks."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and unicodedata.category(chr(code)).startswith("L"):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def letters_and_digits(text: Column) -> Column:
    """Letters and digits of a text in upper case without accents: equal for spellings that differ in case, accents or punctuation."""
    return F.regexp_replace(F.translate(F.upper(text), *accents()), r"[^\p{L}\p{Nd}]+", "")


def trimmed_lower(text: Column) -> Column:
    """Lower case without surrounding white space of any kind."""
    return F.lower(F.regexp_replace(text, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""))

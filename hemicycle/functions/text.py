"""Scalar functions on text and enumerations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of an address, the mark of censored words and what is shown for it, the pattern of tags and entities.
EMAIL = r"^[a-zA-Z0-9.a-zA-Z0-9.!#$%&'*+-/=?^_`{|}~]+@[a-zA-Z0-9]+\.[a-zA-Z]+"
CENSORED, SHOWN = "<censored>", "CENSURADO"
MARKUP = r"<[^>]*>|&[^;]+;"


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive containment; no character is a wildcard."""
    return F.lower(text).contains(needle.lower())


def stripped_html(html: Column) -> Column:
    """A readable line of text: the censoring mark in words, no line feeds, no tags, no entities."""
    marked = F.replace(html, F.lit(CENSORED), F.lit(SHOWN))
    return F.regexp_replace(F.replace(marked, F.lit("\n"), F.lit("")), MARKUP, "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def hashed(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes in lower-case hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def looks_like_email(text: Column) -> Column:
    """Whether a text begins like an address: what follows the match is not tested. Null is false."""
    return F.coalesce(F.length(text) > 0, F.lit(False)) & F.coalesce(text.rlike(EMAIL), F.lit(False))


def identifier_kind(text: Column) -> Column:
    """``email`` for a text with an at sign, else ``userName``."""
    return F.when(text.contains("@"), "email").otherwise("userName")


def enum_name(code: Column, names: Mapping[int, str]) -> Column:
    """The name of a stored code; null for null and for unknown codes."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code]


def enum_code(name: Column, names: Mapping[int, str], strict: bool = False) -> Column:
    """The code of a name; null for null. An unknown name is null, or an error with ``strict``."""
    code = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])[name]
    return F.when(code.isNull() & name.isNotNull(), F.raise_error(F.concat(F.lit("unknown name: "), name)).cast("int")).otherwise(code) if strict else code


def outcome_of_status(status: Column) -> Column:
    """What a client makes of the status of a sign-up."""
    return F.when(status == 200, "created").when(status == 401, "EmailHasAccount").when(status == 402, "UsernameAlreadyExists").otherwise("failed")

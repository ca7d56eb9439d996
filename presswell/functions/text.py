"""Text functions as column expressions, with the semantics of Unicode-aware string code.

Java's ``\\s`` and ``trim`` know ASCII only and ``.`` stops at more line ends
than ``\\n``; the flags (?U) and (?d) put that right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswell.config import BOILERPLATE, ENCODING_REPAIRS


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    """HTML tags to blanks, comments, scripts and styles gone, the commonest entities decoded; texts without < and > stay as they are."""
    out = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(text.contains("<") | text.contains(">"), out).otherwise(text)


def fix_encoding(text: Column, repairs: dict[str, str] = ENCODING_REPAIRS) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), repairs.items(), text)


def remove_boilerplate(text: Column, patterns: list[str] = BOILERPLATE) -> Column:
    return F.regexp_replace(text, "(?iuUd)" + "|".join(patterns), "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends, none before . , ! ? ; :"""
    return F.regexp_replace(strip(F.regexp_replace(text, r"(?U)\s+", " ")), r"(?U)\s+([.,!?;:])", "$1")


def clean_text(text: Column) -> Column:
    """Encoding, tags, furniture, white space, in that order; NULL gives ''."""
    return normalize_whitespace(remove_boilerplate(strip_tags(fix_encoding(F.coalesce(text, F.lit(""))))))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), ""))


def sentence_count(text: Column) -> Column:
    """Non-blank pieces of a split at white space after . ! or ?"""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+")
    return F.size(F.filter(pieces, lambda x: strip(x) != ""))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed; NULL hashes like ''."""
    return F.sha2(F.lower(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))), 256)


def tokens(text: Column) -> Column:
    """Words of two characters or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def safe_divide(a: Column, b: Column) -> Column:
    """NULL for a zero or NULL denominator."""
    return F.try_divide(a, b)

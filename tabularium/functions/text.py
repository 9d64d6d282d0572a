"""Text expressions: tokens, words, identifiers, null tokens, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as a missing cell.
NULL_TOKENS = ("", "null", "none", "nan")

# Unicode white space, written out so that every engine reads it alike.
SPACE = r"[ \x09-\x0D\x1C-\x1F\x85\p{Z}]+"

# The same characters one by one, for trimming without a pattern.
_BLANKS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

_NOT_TOKEN = r"[^\p{L}\p{N}]+"

# Longest identifier the table registry accepts.
MAX_IDENTIFIER = 64


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_TOKEN), "")


def token_text(text: Column) -> Column:
    """The same tokens with one blank between them: one string goes to a Python worker faster than its parts."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_TOKEN, " "))


def words(text: Column) -> Column:
    """White-space separated words, case kept."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_set(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(words(F.lower(text)))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text contains."""
    wanted = word_set(query)
    common = F.size(F.array_intersect(wanted, word_set(text)))
    return common / F.greatest(F.size(wanted), F.lit(1))


def strip(cell: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(cell, F.lit(_BLANKS))


def identifier(name: Column, prefix: str = "t") -> Column:
    """A safe lower-case identifier made from any text."""
    safe = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_]", "_")
    safe = F.lower(F.trim(F.regexp_replace(safe, "_+", "_"), F.lit("_")))
    needs_prefix = safe.rlike(r"^([0-9]|\z)")
    return F.substring(F.when(needs_prefix, F.concat(F.lit(f"{prefix}_"), safe)).otherwise(safe), 1, MAX_IDENTIFIER)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not one."""
    return F.regexp_extract(file_name(path), r"\A(.+?)(\.[^.]*)?\z", 1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)\z", 1))

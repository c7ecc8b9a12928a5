"""Scalar expressions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Latin-1 range; explicit, so that Java and RE2 agree.
LETTERS = "[a-zà-öø-ÿ]+"


def tokens(column: str | Column) -> Column:
    """Lower-cased letter runs of a text, in order, repeats included."""
    text = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"), 1)


#: What the cleaner removes, in order; data, so that rules can be added without code.
CLEANING = (
    (r"https?://[^\x20\x09-\x0D]+", " "),
    (r"(?i)all rights reserved\.?", " "),
    (r"\([^()]*\)", " "),
    (r"[\"'|%$&*#]+", " "),
    (r"[\x20\x09-\x0D]+", " "),
)


def clean(column: str, rules: tuple[tuple[str, str], ...] = CLEANING) -> Column:
    """The rules applied in their order, then trimmed."""
    text = F.col(column)
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


def collapse_repeats(column: str) -> Column:
    """Lower-cased text in which a word that follows itself is left out."""
    return F.regexp_replace(F.lower(column), r"(?U)\b(\w+)(?:\s+\1\b)+", "$1")


def parse_list(written: Column) -> Column:
    """A list out of free text: JSON between brackets, else quoted items, else parts between ; or ,."""
    bracket = F.regexp_extract(written, r"(?s)\[.*\]", 0)
    json = F.from_json(bracket, "array<string>")
    quoted = F.regexp_extract_all(bracket, F.lit("'([^']*)'"), 1)
    plain = F.filter(F.transform(F.split(written, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(json.isNotNull() & (F.size(json) > 0), json).when(F.size(quoted) > 0, quoted).otherwise(plain)

"""Regular expressions for filing text and the expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Kinds of warrant terms and the unit each is reported in.
TERM_KINDS = ("share_quantity", "exercise_price", "expiration_years")
TERM_UNITS = {"share_quantity": "shares", "exercise_price": "USD", "expiration_years": "years"}

# Text patterns for warrant terms and reverse splits.
QUANTITY = (
    r"([\w\-]+(?:\s+[\w\-]+){0,3})\s+[Ww]arrants?\s*"
    r"(?:\([^)]*\)\s*)?"
    r"to purchase up to an aggregate of ([\d,]+)\s+shares"
)
EXERCISE_PRICE = (
    r"([\w\-]+(?:\s+[\w\-]+){0,3})\s+[Ww]arrant\s+"
    r"has an exercise price of \$([\d.]+) per share"
)
NOMINAL_PRICE = r"exercised at a nominal exercise price of \$([\d.]+) per share"
EXPIRATION = r"will expire \w+ \((\d+)\)\s*years? from issuance"
SPLIT_RATIO = r"(\d+)-for-(\d+)\s+reverse stock split"
EFFECTIVE_DATE = r"effective\b.{0,60}?on ([A-Z][a-z]+ \d{1,2}, \d{4})"
NOMINAL_LABEL = "Pre-Funded Warrant"

# Texts every match must contain; a plain search is far cheaper than the pattern.
QUANTITY_HINT = "to purchase up to an aggregate of "
PRICE_HINT = "has an exercise price of $"
NOMINAL_HINT = "exercised at a nominal exercise price of $"
EXPIRATION_HINT = "will expire "


def unicode_pattern(pattern: str, flags: str = "") -> str:
    return f"(?U{flags}){pattern}"


def find_all(text: Column, pattern: str, hint: str) -> Column:
    """Every match of the pattern as an array of snippets, NULL when the hint is absent."""
    return F.when(text.contains(hint), F.regexp_extract_all(text, F.lit(unicode_pattern(pattern)), F.lit(0)))


def group_of(snippet: Column, pattern: str, group: int) -> Column:
    """A group of a snippet that is itself one whole match."""
    return F.regexp_extract(snippet, unicode_pattern(pattern), group)


def split_ratio(text: Column, group: int) -> Column:
    return F.regexp_extract(text, unicode_pattern(SPLIT_RATIO, "i"), group)


def split_effective_date(text: Column) -> Column:
    """First 'effective ... on <Month d, yyyy>'; NULL when absent or not a date."""
    found = F.regexp_extract(text, unicode_pattern(EFFECTIVE_DATE, "id"), 1)
    named = F.initcap(F.nullif(found, F.lit("")))
    return F.try_to_date(named, "MMMM d, yyyy") if hasattr(F, "try_to_date") else F.call_function(
        "try_to_date", named, F.lit("MMMM d, yyyy")
    )

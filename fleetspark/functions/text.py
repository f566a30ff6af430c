"""Text column helpers."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once
from .dates import contains_phrase

# The characters stripped from both ends of keys and chunks.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Patterns.
ASSET_ID_PATTERN = r"(?i)\b((?:WT|PV)-\d+)\b"
FAULT_CODE_PATTERN = r"(?i)\b(E-\d+)\b"
CITATION_PATTERN = r"\[Source (\d+)\]"
NUMBER_PATTERN = r"\b(\d[\d,]*(?:\.\d+)?)\b"

# Manufacturer keywords in the order in which they are tried.
MANUFACTURER_KEYWORDS = (
    (("vestas",), "Vestas"),
    (("siemens", "gamesa"), "Siemens Gamesa"),
    (("longi", "hi-mo"), "LONGi Solar"),
)


def clean_text(value: Column) -> Column:
    """Strip white space of every kind from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def normalise_key(value: Column) -> Column:
    """Stripped, upper-case key."""
    return F.upper(clean_text(value))


def asset_ids(text: Column, pattern: str = ASSET_ID_PATTERN) -> Column:
    """Every asset id in the text, upper-cased, each once, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper))


def fault_code_in(text: Column) -> Column:
    """First fault code in the text, upper-cased; null when there is none."""
    found = F.upper(F.regexp_extract(text, FAULT_CODE_PATTERN, 1))
    return F.when(found != "", found)


def manufacturer_in(text: Column) -> Column:
    """Manufacturer named in the text, by the first keyword rule that matches; null when there is none."""
    lowered = F.lower(text)
    chosen = None
    for keywords, name in MANUFACTURER_KEYWORDS:
        hit = contains_phrase(lowered, keywords)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen


def cited_indices(text: Column) -> Column:
    """Distinct source numbers cited as `[Source n]`."""
    found = F.regexp_extract_all(text, F.lit(CITATION_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda digits: digits.try_cast("bigint")))


def extract_numbers(text: Column, significant_only: bool = True) -> Column:
    """Distinct unsigned numbers in the text. `significant_only` leaves out those below 10 and the years 2000-2030."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(1))
    numbers = F.transform(found, lambda raw: F.translate(raw, ",", "").try_cast("double"))
    if significant_only:
        kept = F.filter(numbers, lambda n: n.isNotNull() & (n >= 10) & ~n.between(2000, 2030))
    else:
        kept = F.filter(numbers, lambda n: n.isNotNull())
    return F.array_distinct(kept)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """True when any of the lower-case phrases occurs in the text, whatever its case."""
    phrases = tuple(phrases)
    return once(F.lower(text), lambda lowered: contains_phrase(lowered, phrases))


def matching(text: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; null text does not match."""
    return F.coalesce(F.rlike(text, F.lit(f"(?i){pattern}")), F.lit(False))


def truncate_with_marker(text: Column, limit: int, marker: str) -> Column:
    """Cut the text after `limit` characters and append the marker, if it is longer than that."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def chunk_id(manufacturer: Column, fault_code: Column, content: Column) -> Column:
    """Stable id of a chunk: manufacturer, fault code (or `overview`) and the whole MD5 of the content.

    A part of the hash would make chunks of large corpora collide, and the index keeps one chunk per id.
    """
    return F.concat_ws(
        "_",
        F.lit("manual"),
        F.translate(F.coalesce(manufacturer, F.lit("")), " ", "_"),
        F.coalesce(F.when(fault_code != "", fault_code), F.lit("overview")),
        F.md5(content),
    )

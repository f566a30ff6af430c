"""Date rules for questions written in plain words."""

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that select a window, in the order in which they are tried, with the first and
# last month of the window. Matching is by substring.
WINDOW_RULES = (
    (("last month",), 6, 6),
    (("past 6 months", "last 6 months", "6 months", "past 6"), 1, 6),
    (("past 3 months", "last 3 months", "past 3", "3 months", "q2"), 4, 6),
    (("q1",), 1, 3),
    (("january",), 1, 1),
    (("february",), 2, 2),
    (("march",), 3, 3),
    (("april",), 4, 4),
    (("may",), 5, 5),
    (("june",), 6, 6),
)
FULL_WINDOW = (1, 6)


def windows() -> list[tuple[int, int]]:
    """Every (first month, last month) window that a question can select, each once."""
    return sorted({(first, last) for _, first, last in WINDOW_RULES} | {FULL_WINDOW})


def _bounds(year: int, first: int, last: int) -> Column:
    end_day = calendar.monthrange(year, last)[1]
    return F.struct(
        F.lit(f"{year}-{first:02d}-01").cast("date").alias("date_start"),
        F.lit(f"{year}-{last:02d}-{end_day}").cast("date").alias("date_end"),
    )


def infer_date_range(question: Column, year: int = 2024) -> Column:
    """Struct `(date_start, date_end)` chosen by the first rule whose phrase occurs in the question."""
    lowered = F.lower(question)
    chosen = None
    for phrases, first, last in WINDOW_RULES:
        hit = contains_phrase(lowered, phrases)
        bounds = _bounds(year, first, last)
        chosen = F.when(hit, bounds) if chosen is None else chosen.when(hit, bounds)
    return chosen.otherwise(_bounds(year, *FULL_WINDOW))


def contains_phrase(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """True when any phrase is a substring of already lower-cased text."""
    hit = F.contains(lowered, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


def date_range_error(start: Column, end: Column) -> Column:
    """Error text when either ISO date is malformed or the range is empty, else null."""
    start_date = F.try_to_date(start, "yyyy-MM-dd")
    end_date = F.try_to_date(end, "yyyy-MM-dd")
    return (
        F.when(start_date.isNull(), F.concat(F.lit("Invalid date: "), F.coalesce(start, F.lit("null"))))
        .when(end_date.isNull(), F.concat(F.lit("Invalid date: "), F.coalesce(end, F.lit("null"))))
        .when(start_date > end_date, F.concat(F.lit("Empty date range: "), start, F.lit(" is after "), end))
    )


def month_label(day: Column) -> Column:
    """`yyyy-MM` label of a date."""
    return F.date_format(day, "yyyy-MM")

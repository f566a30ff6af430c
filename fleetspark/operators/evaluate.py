"""Scoring of answers against evaluation cases."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_any, extract_numbers, once, rounded

# Pass marks, number tolerance, and the phrases of a graceful error.
MIN_RECALL = 0.5
MIN_CONFIDENCE = 0.4
LOW_CONFIDENCE = 0.5
NUMBER_TOLERANCE = 0.015
ERROR_PHRASES = (
    "not found",
    "doesn't exist",
    "did you mean",
    "invalid",
    "check",
    "typo",
    "no asset",
    "skipped",
)


def _share(found: Column, expected: Column) -> Column:
    """Share of the expected items that were found; 1 when none are expected."""
    wanted = F.coalesce(F.size(expected), F.lit(0))
    return F.when(wanted <= 0, 1.0).otherwise(F.size(found) / F.when(wanted > 0, wanted))


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that occur in the answer, whatever their case; 1 when there are none."""
    return _share(_mentioned(answer, keywords), keywords)


def _mentioned(answer: Column, words: Column) -> Column:
    return once(F.lower(answer), lambda lowered: F.filter(words, lambda word: F.contains(lowered, F.lower(word))))


def stated_numbers(answer: Column, numbers: Column) -> Column:
    """The expected numbers that the answer states, within a tolerance relative to the expected one (strictly)."""

    def close(expected: Column, number: Column) -> Column:
        return F.abs(expected - number) / F.greatest(F.abs(expected), F.lit(1.0)) < NUMBER_TOLERANCE

    stated = extract_numbers(answer, significant_only=False)
    return once(
        stated,
        lambda given: F.filter(numbers, lambda expected: F.exists(given, lambda number: close(expected, number))),
    )


def numeric_recall(answer: Column, numbers: Column) -> Column:
    """Share of the expected numbers that the answer states; 1 when none are expected."""
    return _share(stated_numbers(answer, numbers), numbers)


def missing_ids(answer: Column, ids: Column) -> Column:
    """Sorted ids that the answer does not name; empty when it names them all."""
    return F.array_sort(F.array_except(ids, _mentioned(answer, ids)))


def score_cases(cases: DataFrame, outputs: DataFrame, degraded_ids: tuple[str, ...] = ()) -> DataFrame:
    """One scored row per case, with notes on what is amiss. A case without an output is an error with confidence 0.

    `passed` needs the routing, both recalls, the confidence, and a graceful error where one is expected. Naming every
    degraded asset is reported on its own.
    """
    ids = F.array(*[F.lit(one) for one in degraded_ids]).cast("array<string>")
    none = F.array().cast("array<string>")
    joined = cases.join(outputs, "id", "left").withColumns(
        {
            "answer": F.coalesce("answer", F.lit("ERROR: no output")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "tools_used": F.coalesce("tools_used", none),
            "latency_s": F.coalesce("latency_s", F.lit(0.0)),
        }
    )
    expects_error = F.coalesce(F.col("expected_error"), F.lit(False))
    asks_degraded = F.coalesce(F.col("checks_degradation"), F.lit(False))
    expected_tools = F.coalesce("expected_tools", none)
    scored = joined.withColumns(
        {
            "missing_tools": F.array_except(expected_tools, "tools_used"),
            "found_keywords": _mentioned(F.col("answer"), F.col("expected_keywords")),
            "found_numbers": stated_numbers(F.col("answer"), F.col("expected_numbers")),
            "has_error_handling": expects_error & contains_any(F.col("answer"), ERROR_PHRASES),
            "missing": F.when(asks_degraded, missing_ids(F.col("answer"), ids)).otherwise(none),
        }
    ).withColumns(
        {
            "tool_routing_correct": F.size("missing_tools") == 0,
            "keyword_recall": _share(F.col("found_keywords"), F.col("expected_keywords")),
            "numeric_recall": _share(F.col("found_numbers"), F.col("expected_numbers")),
            "degradation_detected": asks_degraded & (F.size("missing") == 0),
        }
    )

    def note(condition: Column, *parts: Column | str) -> Column:
        return F.when(condition, F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts]))

    def count(items: str) -> Column:
        return F.size(items).cast("string")

    no_numbers = F.array().cast("array<double>")
    unstated = F.transform(
        F.filter(F.coalesce("expected_numbers", no_numbers), lambda number: ~F.array_contains("found_numbers", number)),
        lambda number: F.concat(F.lit("number not stated: "), number.cast("string")),
    )
    notes = F.concat(
        F.array_compact(
            F.array(
                note(~F.col("tool_routing_correct"), "tools not used: ", F.array_join("missing_tools", ", ")),
                note(
                    F.col("keyword_recall") < MIN_RECALL,
                    "keywords found: ",
                    count("found_keywords"),
                    " of ",
                    count("expected_keywords"),
                ),
            )
        ),
        unstated,
        F.array_compact(
            F.array(
                note(expects_error & ~F.col("has_error_handling"), "no graceful error"),
                note(F.size("missing") > 0, "degraded assets not named: ", F.array_join("missing", ", ")),
            )
        ),
    )
    return scored.select(
        "id",
        "confidence",
        "latency_s",
        "tool_routing_correct",
        "keyword_recall",
        "numeric_recall",
        "has_error_handling",
        "degradation_detected",
        (
            F.col("tool_routing_correct")
            & (F.col("keyword_recall") >= MIN_RECALL)
            & (F.col("numeric_recall") >= MIN_RECALL)
            & (F.col("confidence") >= MIN_CONFIDENCE)
            & (~expects_error | F.col("has_error_handling"))
        ).alias("passed"),
        notes.alias("notes"),
    )


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Totals and means over the scored cases, in one row; no row when there are no cases."""
    return (
        scored.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("passed").alias("passed"),
            rounded(F.avg(F.col("passed").cast("double")), 3).alias("pass_rate"),
            rounded(F.avg("confidence"), 3).alias("avg_confidence"),
            rounded(F.avg("keyword_recall"), 3).alias("avg_keyword_recall"),
            rounded(F.avg("numeric_recall"), 3).alias("avg_numeric_recall"),
            rounded(F.avg(F.col("tool_routing_correct").cast("double")), 3).alias("tool_routing_accuracy"),
            rounded(F.avg("latency_s"), 2).alias("avg_latency_s"),
            rounded(F.avg((F.col("confidence") < LOW_CONFIDENCE).cast("double")), 3).alias("low_confidence_rate"),
        )
        .filter("total > 0")
    )

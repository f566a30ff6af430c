"""Checks of written answers against the results they were written from."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import materialised
from ..functions import cited_indices, clamp01, contains_any, explode_rows, extract_numbers, once, rounded

# Tolerance, judge trigger, phrases and patterns that count against an answer.
NUMERIC_TOLERANCE = 0.015
JUDGE_TRIGGER = 0.6
UNCERTAIN_PHRASES = (
    "i don't have access",
    "i cannot access",
    "i'm unable to",
    "as of my knowledge cutoff",
    "i don't know",
    "cannot be determined",
    "i'm not sure",
    "i am not able",
    "i have no information",
)
BAD_PATTERNS = (r"\b202[56]-\d{2}-\d{2}\b", r"i (made up|fabricated|invented)")

# What each check adds to the score.
BASE = 0.50
CITED = 0.20
VALID_INDICES = 0.10
ORPHANS = -0.10
REAL_DATA = 0.10
NO_PHRASES = 0.10
BAD_PATTERN = -0.20
NUMBERS_MATCH = 0.10
NUMBERS_DIFFER = -0.20
JUDGE_GOOD = 0.10
JUDGE_BAD = -0.15
JUDGE_MISSING = -0.10


def citations(answers: DataFrame, tool_results: DataFrame, snippet: int = 200) -> DataFrame:
    """Citation records: the results that an answer cites by number, with fields of their JSON data."""
    cited = explode_rows(answers, ["request_id"], cited_indices(F.col("answer")), "source_index")
    data = F.col("data_json")

    def field(name: str) -> Column:
        nested = F.get_json_object(data, f"$.data.{name}")
        direct = F.get_json_object(data, f"$.{name}")
        return F.when(F.get_json_object(data, "$.data").isNotNull(), nested).otherwise(direct).alias(name)

    failed = F.col("error").isNotNull() & (F.col("error") != "")
    return tool_results.join(cited, ["request_id", "source_index"], "left_semi").select(
        "request_id",
        F.col("source_index").cast("bigint").alias("index"),
        "tool",
        F.col("tool").alias("doc_type"),
        field("asset_id"),
        field("fault_code"),
        field("manufacturer"),
        F.when(data.isNotNull() & ~failed, 1.0).otherwise(0.0).alias("score"),
        F.substring(F.coalesce(data, F.lit("")), 1, snippet).alias("snippet"),
    )


def orphan_citations(answers: DataFrame, tool_results: DataFrame) -> DataFrame:
    """Cited numbers without a result of that number. The join key has the number in it, so no request is hot."""
    cited = explode_rows(answers, ["request_id"], cited_indices(F.col("answer")), "source_index")
    present = tool_results.select("request_id", F.col("source_index").cast("bigint").alias("source_index"))
    return cited.join(present, ["request_id", "source_index"], "left_anti")


def numeric_matches(
    answer_numbers: DataFrame, source_numbers: DataFrame, key: str = "request_id", tolerance: float = NUMERIC_TOLERANCE
) -> DataFrame:
    """For each (key, number) of the answers, whether some source number s of the key has |a - s| / max(|s|, 1) <= t.

    Numbers are at least 10, so the matching s form the interval [a/(1+t), a/(1-t)], whose width is constant on a log
    scale. Sources are folded into log buckets half that wide, keeping the smallest and largest of each. An interval
    then covers three buckets at most; the outer ones are settled by the largest or smallest member and an inner one
    matches as a whole. So every number meets a fixed number of rows, however many sources its key has, and testing the
    two extremes of each bucket with the original formula is exact.
    """
    extremes = _extremes(source_numbers, key, tolerance)
    return _matches(answer_numbers, extremes, key, tolerance)


def _bucket(value: Column, tolerance: float) -> Column:
    spread = math.log((1 + tolerance) / (1 - tolerance)) / 2
    return F.floor(F.log(value) / F.lit(spread)).cast("bigint")


def _extremes(source_numbers: DataFrame, key: str, tolerance: float) -> DataFrame:
    """The smallest and largest source number of each (key, bucket), and the rows `n` that fell there."""
    return source_numbers.groupBy(key, _bucket(F.col("number"), tolerance).alias("bucket")).agg(
        F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n")
    )


def _matches(answer_numbers: DataFrame, extremes: DataFrame, key: str, tolerance: float) -> DataFrame:
    """`numeric_matches`, given the extremes of the source numbers."""

    def close(source: Column) -> Column:
        return F.abs(F.col("number") - source) / F.greatest(F.abs(source), F.lit(1.0)) <= tolerance

    # A margin of one part in 1e9 keeps rounding at the ends from hiding a bucket; the formula decides afterwards.
    first = _bucket(F.col("number") / (1 + tolerance) * (1 - 1e-9), tolerance)
    last = _bucket(F.col("number") / (1 - tolerance) * (1 + 1e-9), tolerance)
    probes = answer_numbers.select(key, "number").distinct().withColumn("bucket", F.explode(F.sequence(first, last)))
    return (
        probes.join(extremes, [key, "bucket"], "left")
        .groupBy(key, "number")
        .agg(F.coalesce(F.bool_or(close(F.col("low")) | close(F.col("high"))), F.lit(False)).alias("matched"))
    )


def _numbers_of(rows: DataFrame, text: str) -> DataFrame:
    return explode_rows(rows, ["request_id"], extract_numbers(F.col(text)), "number")


def numeric_faithfulness(
    answers: DataFrame, tool_results: DataFrame, tolerance: float = NUMERIC_TOLERANCE
) -> DataFrame:
    """Per answer: how many numbers it has, how many are not in the sources, and the score change that follows.

    The change is 0 when either side has no numbers.
    """
    return _faithfulness(answers, _numbers_of(tool_results.filter(F.col("data_json").isNotNull()), "data_json"), tolerance)


def _faithfulness(answers: DataFrame, source_numbers: DataFrame, tolerance: float) -> DataFrame:
    """`numeric_faithfulness`, given `request_id` and `number` of the sources.

    Their extremes are stored, since both the comparison and the count of numbers come from them. A number lies in one bucket.
    """
    extremes = materialised(_extremes(source_numbers.distinct(), "request_id", tolerance))
    counts = (
        _matches(_numbers_of(answers, "answer"), extremes, "request_id", tolerance)
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("answer_numbers"), F.count_if(~F.col("matched")).alias("mismatches"))
    )
    source_counts = extremes.groupBy("request_id").agg(F.sum("n").alias("source_numbers"))
    joined = (
        answers.select("request_id")
        .join(counts, "request_id", "left")
        .join(source_counts, "request_id", "left")
        .fillna(0, ["answer_numbers", "mismatches", "source_numbers"])
    )
    checked = (F.col("answer_numbers") > 0) & (F.col("source_numbers") > 0)
    return joined.select(
        "request_id",
        "answer_numbers",
        "source_numbers",
        F.when(checked, F.col("mismatches")).otherwise(0).alias("mismatches"),
        F.when(~checked, 0.0).when(F.col("mismatches") > 0, NUMBERS_DIFFER).otherwise(NUMBERS_MATCH).alias("delta_numeric"),
    )


def judge_delta(judge_score: Column) -> Column:
    """Score change for a judge's verdict; a missing verdict counts as a failed call."""
    return (
        F.when(judge_score.isNull(), JUDGE_MISSING)
        .when(judge_score >= 0.8, JUDGE_GOOD)
        .when(judge_score >= 0.5, 0.0)
        .otherwise(JUDGE_BAD)
    )


def confidence_level(confidence: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def confidence(
    answers: DataFrame,
    tool_results: DataFrame,
    phrases: tuple[str, ...] = UNCERTAIN_PHRASES,
    patterns: tuple[str, ...] = BAD_PATTERNS,
    tolerance: float = NUMERIC_TOLERANCE,
) -> DataFrame:
    """Confidence of each answer, with the change of every check and a summary of the failed ones.

    The judge's change applies only when `answers` has a `judge_score` column and the score so far is below the trigger.
    A bad pattern costs its penalty once for each pattern that matches.
    """
    with_judge = "judge_score" in answers.columns
    # Three checks look at the results, so they are read once and what the checks need of them is stored.
    data = F.col("data_json")
    results = materialised(
        tool_results.select(
            "request_id",
            "source_index",
            (data.isNotNull() & ~(F.coalesce(F.col("status"), F.lit("")) == "error")).alias("has_data"),
            extract_numbers(data).alias("numbers"),
        )
    )
    data_found = results.groupBy("request_id").agg(F.bool_or("has_data").alias("has_data"))
    orphans = orphan_citations(answers, results).groupBy("request_id").agg(F.count(F.lit(1)).alias("orphans"))
    source_numbers = explode_rows(results, ["request_id"], F.col("numbers"), "number")
    numbers = _faithfulness(answers, source_numbers, tolerance).select("request_id", "delta_numeric")

    lowered = F.lower("answer")
    bad_hits = F.lit(0)
    for pattern in patterns:
        bad_hits = bad_hits + F.when(F.rlike(lowered, F.lit(pattern)), 1).otherwise(0)
    kept = ["request_id", "judge_score"] if with_judge else ["request_id"]
    own = answers.select(
        *kept,
        (F.size(cited_indices(F.col("answer"))) > 0).alias("cites"),
        contains_any(F.col("answer"), phrases).alias("uncertain"),
        bad_hits.cast("bigint").alias("bad_patterns"),
    )
    joined = (
        own.join(data_found, "request_id", "left")
        .join(orphans, "request_id", "left")
        .join(numbers, "request_id", "left")
        .withColumns(
            {
                "delta_citations": F.when(F.col("cites"), CITED).otherwise(0.0),
                "delta_indices": F.when(F.col("orphans").isNull(), VALID_INDICES).otherwise(ORPHANS),
                "delta_data": F.when(F.coalesce("has_data", F.lit(False)), REAL_DATA).otherwise(0.0),
                "delta_phrases": F.when(F.col("uncertain"), 0.0).otherwise(NO_PHRASES),
                "delta_patterns": rounded(F.col("bad_patterns") * BAD_PATTERN, 2),
            }
        )
    )
    so_far = (
        F.lit(BASE)
        + F.col("delta_citations")
        + F.col("delta_indices")
        + F.col("delta_data")
        + F.col("delta_phrases")
        + F.col("delta_patterns")
        + F.col("delta_numeric")
    )
    # Sums of tenths are compared after rounding, so that 0.6 is not below 0.6.
    judged = joined.withColumn("so_far", rounded(so_far, 6))
    asked = (F.col("so_far") < JUDGE_TRIGGER) if with_judge else F.lit(False)
    judge = judge_delta(F.col("judge_score")) if with_judge else F.lit(0.0)
    scored = judged.withColumn("judge_asked", asked).withColumn(
        "delta_judge", F.when(F.col("judge_asked"), judge).otherwise(0.0)
    )
    score = clamp01(F.col("so_far") + F.col("delta_judge"))
    failures = F.array_compact(
        F.array(
            F.when(~F.col("cites"), "citations present"),
            F.when(F.col("orphans").isNotNull(), "valid source indices"),
            F.when(~F.coalesce("has_data", F.lit(False)), "real data returned"),
            F.when(F.col("uncertain"), "no uncertainty phrases"),
            F.when(F.col("bad_patterns") > 0, "no suspicious patterns"),
            F.when(F.col("delta_numeric") < 0, "numeric faithfulness"),
            F.when(F.col("delta_judge") < 0, "semantic judge"),
        )
    )
    return (
        scored.withColumn("confidence", score)
        .withColumn("failed_checks", failures)
        .select(
            "request_id",
            "confidence",
            confidence_level(F.col("confidence")).alias("level"),
            "delta_citations",
            "delta_indices",
            "delta_data",
            "delta_phrases",
            "delta_patterns",
            "delta_numeric",
            "delta_judge",
            check_status(F.col("delta_numeric")).alias("numeric_status"),
            F.when(~F.col("judge_asked"), "skip").when(F.col("delta_judge") < 0, "fail").otherwise("pass").alias(
                "judge_status"
            ),
            "failed_checks",
            check_summary(F.col("failed_checks")).alias("checks"),
        )
    )


def check_status(delta: Column) -> Column:
    """pass, fail, or skip when there was nothing to check."""
    return F.when(delta > 0, "pass").when(delta < 0, "fail").otherwise("skip")


def check_summary(failed: Column) -> Column:
    """`all checks passed`, the name of the only failed check, or how many failed."""
    return (
        F.when(F.size(failed) == 0, "all checks passed")
        .when(F.size(failed) == 1, F.concat(F.lit("warning: "), F.get(failed, F.lit(0))))
        .otherwise(F.concat(F.lit("warnings: "), F.size(failed).cast("string"), F.lit(" checks failed")))
    )


def phrase_hits(answers: DataFrame, phrases: tuple[str, ...] = UNCERTAIN_PHRASES) -> DataFrame:
    """Uncertainty phrases that each answer contains."""
    listed = F.array(*[F.lit(phrase) for phrase in phrases])
    found = once(F.lower("answer"), lambda lowered: F.filter(listed, lambda phrase: F.contains(lowered, phrase)))
    return explode_rows(answers, ["request_id"], found, "phrase")

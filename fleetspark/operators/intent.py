"""What a question asks for, as columns of the requests table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import asset_ids, fault_code_in, infer_date_range, manufacturer_in, month_label, once
from ..functions.dates import contains_phrase

# The phrases behind each flag, and the known locations in the order in which they are tried.
BROAD_PHRASES = ("which assets", "all assets", "underperform", "degraded", "declining", "consistent")
AVAILABILITY_PHRASES = ("availability", "below 90", "below 80", "uptime")
ENERGY_PHRASES = ("underperform", "declining", "degraded", "output", "energy")
LOCATIONS = (
    "Northern Spain",
    "Castile",
    "Galicia",
    "Aragon",
    "Navarre",
    "La Rioja",
    "Southern Spain",
    "Andalusia",
    "Murcia",
    "Extremadura",
)


def known_location(question: Column, locations: tuple[str, ...] = LOCATIONS) -> Column:
    """The first listed location that the question names; null when there is none."""
    names = F.array(*[F.lit(name) for name in locations])
    named = once(F.lower(question), lambda lowered: F.filter(names, lambda name: F.contains(lowered, F.lower(name))))
    return F.get(named, F.lit(0))


def with_intent(requests: DataFrame, year: int = 2024, locations: tuple[str, ...] = LOCATIONS) -> DataFrame:
    """Requests with their ids, window, flags, location, comparison month and the `kind` of report that answers them."""
    lowered = F.lower("question")
    return (
        requests.withColumns(
            {
                "mentioned_ids": asset_ids(F.col("question")),
                "window": infer_date_range(F.col("question"), year),
                "wants_availability": contains_phrase(lowered, AVAILABILITY_PHRASES),
                "wants_energy": contains_phrase(lowered, ENERGY_PHRASES),
                "location": known_location(F.col("question"), locations),
            }
        )
        .withColumns(
            {
                "date_start": F.col("window.date_start"),
                "date_end": F.col("window.date_end"),
                "is_broad": contains_phrase(lowered, BROAD_PHRASES) & (F.size("mentioned_ids") == 0),
            }
        )
        .withColumns(
            {
                "comparison_month": F.when(
                    month_label(F.col("date_start")) == month_label(F.col("date_end")), month_label(F.col("date_start"))
                ),
                "kind": F.when(~F.col("is_broad"), "per_asset")
                .when(F.col("wants_availability") & ~F.col("wants_energy"), "low_availability")
                .when(F.col("wants_availability"), "combined")
                .otherwise("declining_energy"),
            }
        )
        .drop("window")
    )


def with_search_filters(requests: DataFrame) -> DataFrame:
    """Requests with the fault code and the manufacturer by which a search is narrowed; null means no filter."""
    return requests.withColumns(
        {
            "fault_code": fault_code_in(F.col("question")),
            "manufacturer": manufacturer_in(F.col("question")),
        }
    )


def upstream_gate(tool_results: DataFrame) -> DataFrame:
    """Requests whose asset lookup reported an error, also next to resolved ids; dependent reports are skipped."""
    failed = (F.col("tool") == "asset_lookup") & F.col("error").isNotNull() & (F.col("error") != "")
    return tool_results.groupBy("request_id").agg(
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("skipped"),
        F.min(F.when(failed, F.struct("source_index", "error")))["error"].alias("reason"),
    )


def requested_assets(requests: DataFrame, lookups: DataFrame) -> DataFrame:
    """Ids of each request: those that the lookup resolved, or those in the text when it resolved none."""
    resolved = lookups.select("request_id", F.col("asset_ids").alias("resolved"))
    return requests.join(resolved, "request_id", "left").select(
        "request_id",
        F.when(F.size("resolved") > 0, F.col("resolved"))
        .otherwise(asset_ids(F.col("question")))
        .alias("asset_ids"),
    )

"""History, due dates and costs of maintenance."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import explode_rows, matching, rounded
from .telemetry import select_rows

# Service interval in days, and the date on which overdue is judged.
CADENCE_DAYS = 180
AS_OF = "2024-07-01"

LOGGED_CODE = r"(E-\d+)"


def maintenance_summary(
    logs: DataFrame,
    date_start: str | None = None,
    date_end: str | None = None,
    by: Iterable[str] = ("asset_id",),
    as_of: str = AS_OF,
    cadence_days: int = CADENCE_DAYS,
) -> DataFrame:
    """Counts, costs, hours, last event and due date of each key that has an event in the window.

    The due date looks at the full history and the rest at the window, so the window is a condition inside the
    aggregates: one scan and one shuffle serve both.
    """
    inside = F.lit(True)
    if date_start:
        inside = inside & (F.col("date") >= F.lit(date_start).cast("date"))
    if date_end:
        inside = inside & (F.col("date") <= F.lit(date_end).cast("date"))
    inside = F.coalesce(inside, F.lit(False))

    def within(value: Column) -> Column:
        return F.when(F.col("inside"), value)

    def kind(name: str) -> Column:
        return F.coalesce(F.col("type") == name, F.lit(False))

    last = F.max(F.when(F.col("inside") & F.col("date").isNotNull(), F.struct("date", "log_id", "type")))
    last_scheduled = F.max(F.when(kind("scheduled"), F.col("date")))
    return (
        logs.withColumn("inside", inside)
        .groupBy(*by)
        .agg(
            F.count_if("inside").alias("total_events"),
            F.count_if(F.col("inside") & kind("scheduled")).alias("scheduled_count"),
            F.count_if(F.col("inside") & kind("corrective")).alias("corrective_count"),
            rounded(F.coalesce(F.sum(within(F.col("cost_eur"))), F.lit(0.0)), 2).alias("total_cost_eur"),
            rounded(F.avg(within(F.col("cost_eur"))), 2).alias("avg_cost_eur"),
            rounded(F.coalesce(F.sum(within(F.col("duration_hours"))), F.lit(0.0)), 2).alias("total_duration_hours"),
            F.min(within(F.col("date"))).alias("first_date"),
            last["date"].alias("last_maintenance_date"),
            last["type"].alias("last_maintenance_type"),
            F.date_add(last_scheduled, cadence_days).alias("estimated_next_scheduled"),
            F.coalesce(
                F.datediff(F.lit(as_of).cast("date"), last_scheduled) > cadence_days, F.lit(False)
            ).alias("maintenance_overdue"),
        )
        .filter("total_events > 0")
    )


def maintenance_due(
    logs: DataFrame,
    by: Iterable[str] = ("asset_id",),
    as_of: str = AS_OF,
    cadence_days: int = CADENCE_DAYS,
) -> DataFrame:
    """Last scheduled service of each key, the next one, and whether more than the interval has passed."""
    last = F.max(F.when(F.col("type") == "scheduled", F.col("date")))
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_scheduled"))
    return (
        logs.groupBy(*by)
        .agg(last.alias("last_scheduled"))
        .withColumns(
            {
                "estimated_next_scheduled": F.date_add("last_scheduled", cadence_days),
                "days_since": days.cast("bigint"),
                "maintenance_overdue": F.coalesce(days > cadence_days, F.lit(False)),
            }
        )
    )


def last_event(logs: DataFrame, by: Iterable[str] = ("asset_id",)) -> DataFrame:
    """Date and kind of the latest dated event; the larger log id wins on the same day."""
    latest = F.max(F.when(F.col("date").isNotNull(), F.struct("date", "log_id", "type")))
    return (
        logs.groupBy(*by)
        .agg(latest.alias("latest"))
        .select(
            *by,
            F.col("latest.date").alias("last_maintenance_date"),
            F.col("latest.type").alias("last_maintenance_type"),
        )
    )


def technician(logs: DataFrame) -> Column:
    """Who did the work; `unknown` where the log has no such column."""
    named = F.col("technician") if "technician" in logs.columns else F.lit("unknown")
    return named.alias("technician")


def events(
    logs: DataFrame,
    asset_ids: Iterable | DataFrame | None = None,
    date_start: str | None = None,
    date_end: str | None = None,
    description_limit: int = 300,
) -> DataFrame:
    """Event list by date, with the description cut for display."""
    return (
        select_rows(logs, asset_ids, date_start, date_end)
        .select(
            "log_id",
            "asset_id",
            "date",
            "type",
            F.substring("description", 1, description_limit).alias("description"),
            technician(logs),
            "duration_hours",
            "parts_replaced",
            rounded(F.col("cost_eur"), 2).alias("cost_eur"),
        )
        .orderBy(F.asc_nulls_last("date"), "log_id")
    )


def codes_in_logs(logs: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Distinct fault codes that the descriptions mention."""
    found = F.regexp_extract_all("description", F.lit(LOGGED_CODE), F.lit(1))
    return explode_rows(logs, by, found, "fault_code").distinct()


def parts_frequency(logs: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Events per replaced part, most frequent first."""
    return (
        logs.groupBy(*by, "parts_replaced")
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(*by, F.desc("events"), "parts_replaced")
    )


def search_events(logs: DataFrame, column: str, pattern: str, description_limit: int = 200) -> DataFrame:
    """Events whose column matches the pattern, by date. Null dates stay, at the end."""
    return events(logs.filter(matching(F.col(column), pattern)), description_limit=description_limit).drop("technician")


def search_by_fault_code(logs: DataFrame, fault_code: str) -> DataFrame:
    """Number and total cost of the events whose description matches the code, in one row."""
    return _search_totals(logs.filter(matching(F.col("description"), fault_code)))


def search_by_part(logs: DataFrame, part_keyword: str) -> DataFrame:
    """Number, distinct assets and total cost of the events that replaced a matching part, in one row."""
    return _search_totals(logs.filter(matching(F.col("parts_replaced"), part_keyword)))


def _search_totals(found: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    return found.agg(
        F.when(rows == 0, "no_data").otherwise("ok").alias("status"),
        rows.alias("event_count"),
        F.countDistinct("asset_id").alias("assets_affected"),
        rounded(F.coalesce(F.sum("cost_eur"), F.lit(0.0)), 2).alias("total_cost_eur"),
    )


def assets_affected(logs: DataFrame, part_keyword: str) -> DataFrame:
    """Assets with a matching part, in the order in which they first had one."""
    return (
        logs.filter(matching(F.col("parts_replaced"), part_keyword))
        .groupBy("asset_id")
        .agg(F.min("date").alias("first_date"), F.count(F.lit(1)).alias("events"))
        .orderBy(F.asc_nulls_last("first_date"), "asset_id")
    )

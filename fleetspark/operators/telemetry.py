"""Summaries of the telemetry fact. `by` names the columns of a report's key; an empty `by` covers all rows."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_label, rounded
from .seasonal import has_fault


def select_rows(
    rows: DataFrame,
    asset_ids: Iterable | DataFrame | None = None,
    date_start: str | None = None,
    date_end: str | None = None,
) -> DataFrame:
    """Rows of the given assets within a closed date range. Empty or absent filters do not restrict.

    Ids can be a list, or a table with `asset_id`, which becomes a semi join. A table partitioned by `month` is also
    filtered by month, so that Spark lists and reads the folders of the range only.
    """
    if dict(rows.dtypes).get("month") == "string":
        if date_start:
            rows = rows.filter(F.col("month") >= date_start[:7])
        if date_end:
            rows = rows.filter(F.col("month") <= date_end[:7])
    if date_start:
        rows = rows.filter(F.col("date") >= F.lit(date_start).cast("date"))
    if date_end:
        rows = rows.filter(F.col("date") <= F.lit(date_end).cast("date"))
    if isinstance(asset_ids, DataFrame):
        return rows.join(asset_ids.select("asset_id"), "asset_id", "left_semi")
    ids = list(asset_ids or ())
    return rows.filter(F.col("asset_id").isin(ids)) if ids else rows


def telemetry_summary(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Date span, row count, energy, availability and fault rows. The status is `no_data` for an empty selection.

    The averages of wind and irradiance are null when no row has a value.
    """
    days = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        F.when(days == 0, "no_data").otherwise("ok").alias("status"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        days.alias("days"),
        rounded(F.avg("energy_kwh"), 2).alias("avg_energy_kwh"),
        rounded(F.coalesce(F.sum("energy_kwh"), F.lit(0.0)), 2).alias("total_energy_kwh"),
        rounded(F.avg("availability_pct"), 2).alias("avg_availability_pct"),
        rounded(F.min("availability_pct"), 2).alias("min_availability_pct"),
        rounded(F.avg("avg_wind_speed_ms"), 2).alias("avg_wind_speed_ms"),
        rounded(F.avg("irradiance_wm2"), 2).alias("avg_irradiance_wm2"),
        F.count_if(has_fault()).alias("fault_count"),
    )


def fault_summary(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Rows, first description and date span of each fault code."""
    return (
        rows.filter(has_fault())
        .groupBy(*by, "fault_code")
        .agg(
            F.count(F.lit(1)).alias("fault_count"),
            F.min(F.struct("date", "fault_description"))["fault_description"].alias("description"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def monthly_trend(rows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Mean energy and availability of each month (unrounded), by month."""
    return (
        rows.groupBy(*by, month_label(F.col("date")).alias("month"))
        .agg(F.avg("energy_kwh").alias("avg_energy"), F.avg("availability_pct").alias("avg_avail"))
        .orderBy(*by, "month")
    )


def low_availability_assets(
    telemetry: DataFrame,
    date_start: str = "2024-03-01",
    date_end: str = "2024-06-30",
    threshold: float = 90.0,
) -> DataFrame:
    """Assets whose mean availability, rounded to two places, is below the threshold; lowest first.

    Here every non-null fault code counts as a fault, also an empty one.
    """
    return (
        select_rows(telemetry, None, date_start, date_end)
        .groupBy("asset_id")
        .agg(
            rounded(F.avg("availability_pct"), 2).alias("mean_availability_pct"),
            rounded(F.min("availability_pct"), 2).alias("min_availability_pct"),
            F.count("fault_code").alias("fault_events_in_period"),
        )
        .filter(F.col("mean_availability_pct") < threshold)
        .orderBy("mean_availability_pct", "asset_id")
    )


def low_availability_count(low: DataFrame, threshold: float = 90.0) -> DataFrame:
    """How many assets were found, in one row."""
    return low.agg(F.count(F.lit(1)).alias("low_availability_count")).withColumn(
        "threshold_pct", F.lit(float(threshold))
    )


def fault_history(telemetry: DataFrame, asset_ids: Iterable | DataFrame | None = None) -> DataFrame:
    """Fault rows of the given assets (or all) by date. An asset without faults has no rows."""
    return (
        select_rows(telemetry, asset_ids)
        .filter(has_fault())
        .select("asset_id", "date", "fault_code", "fault_description", "availability_pct")
        .orderBy("asset_id", F.asc_nulls_last("date"), "fault_code")
    )


def fault_history_counts(telemetry: DataFrame, assets: DataFrame) -> DataFrame:
    """Fault rows of each asset; zero for assets without faults."""
    counts = telemetry.filter(has_fault()).groupBy("asset_id").agg(F.count(F.lit(1)).alias("fault_count"))
    return assets.select("asset_id").join(counts, "asset_id", "left").fillna(0, ["fault_count"])


def combined_report(low: DataFrame, declining: DataFrame) -> DataFrame:
    """Low-availability and declining-energy assets in one table, told apart by `section`."""
    availability = low.select(
        F.lit("low_availability").alias("section"),
        "asset_id",
        F.col("mean_availability_pct"),
        F.lit(None).cast("double").alias("avail_drop_pct_pts"),
    )
    energy = declining.select(
        F.lit("declining_energy").alias("section"),
        "asset_id",
        F.lit(None).cast("double").alias("mean_availability_pct"),
        "avail_drop_pct_pts",
    )
    return availability.unionByName(energy)

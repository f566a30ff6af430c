"""Month tables: the facts folded into one mergeable row per asset and month.

Every window a question can select consists of whole months, so reports for many requests meet these few rows instead of
readings. Store the tables when many batches use them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded
from .maintenance import codes_in_logs, technician
from .seasonal import AFTER_MONTHS, BEFORE_MONTHS, has_fault
from .shape import LIST_CAP

# What a report is about: a request's assets (none for the fleet) and its window.
KEY = ["asset_ids", "date_start", "date_end"]


def first_of_month(day: str) -> Column:
    return F.to_date(F.trunc(day, "MM"))


def telemetry_months(telemetry: DataFrame) -> DataFrame:
    """One row of mergeable figures per asset and month. Store it as a table when many batches use it."""
    figures = {
        "energy": "energy_kwh",
        "availability": "availability_pct",
        "wind": "avg_wind_speed_ms",
        "irradiance": "irradiance_wm2",
    }
    sums = [F.sum(column).alias(f"{name}_sum") for name, column in figures.items()]
    counts = [F.count(column).alias(f"{name}_n") for name, column in figures.items()]
    return telemetry.groupBy("asset_id", first_of_month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *sums,
        *counts,
        F.min("availability_pct").alias("availability_min"),
        F.count_if(has_fault()).alias("fault_rows"),
        F.count("fault_code").alias("coded_rows"),
    )


def fault_months(telemetry: DataFrame) -> DataFrame:
    """One row per asset, month and fault code."""
    return (
        telemetry.filter(has_fault())
        .groupBy("asset_id", first_of_month("date").alias("month"), "fault_code")
        .agg(
            F.count(F.lit(1)).alias("fault_rows"),
            F.min(F.struct("date", "fault_description")).alias("first_event"),
            F.max("date").alias("last_date"),
        )
    )


def maintenance_months(logs: DataFrame) -> DataFrame:
    """One row of mergeable figures per asset and month of the maintenance log; undated events are in no month."""
    return (
        logs.filter(F.col("date").isNotNull())
        .groupBy("asset_id", first_of_month("date").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("type") == "scheduled").alias("scheduled"),
            F.count_if(F.col("type") == "corrective").alias("corrective"),
            F.sum("cost_eur").alias("cost_sum"),
            F.count("cost_eur").alias("cost_n"),
            F.sum("duration_hours").alias("hours_sum"),
            F.min("date").alias("first_date"),
            F.max(F.struct("date", "log_id", "type")).alias("last_event"),
            F.max(F.when(F.col("type") == "scheduled", F.col("date"))).alias("last_scheduled"),
        )
    )


def event_months(logs: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """The first events of each asset and month.

    The first `cap` events of any assets over any months are among them, so lists can be cut from this small table.
    """
    dated = logs.filter(F.col("date").isNotNull()).withColumn("month", first_of_month("date"))
    first = Window.partitionBy("asset_id", "month").orderBy("date", "log_id")
    return (
        dated.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= cap)
        .select(
            "asset_id",
            "month",
            F.struct(
                "date",
                "log_id",
                "asset_id",
                "type",
                F.substring("description", 1, 300).alias("description"),
                technician(logs),
                "duration_hours",
                "parts_replaced",
                rounded(F.col("cost_eur"), 2).alias("cost_eur"),
            ).alias("event"),
        )
    )


def part_months(logs: DataFrame) -> DataFrame:
    """Events per asset, month and replaced part."""
    dated = logs.filter(F.col("date").isNotNull())
    return dated.groupBy("asset_id", first_of_month("date").alias("month"), "parts_replaced").agg(
        F.count(F.lit(1)).alias("events")
    )


def code_months(logs: DataFrame) -> DataFrame:
    """Fault codes that the descriptions of an asset's month mention."""
    dated = logs.filter(F.col("date").isNotNull()).withColumn("month", first_of_month("date"))
    return codes_in_logs(dated, by=["asset_id", "month"])


def _asset_months(keys: DataFrame) -> DataFrame:
    """The (asset, month) pairs that a key covers; a key without ids covers the fleet, shown as a null asset."""
    ids = F.when(F.size("asset_ids") > 0, F.col("asset_ids")).otherwise(F.array(F.lit(None).cast("string")))
    months = F.sequence(first_of_month("date_start"), first_of_month("date_end"), F.expr("interval 1 month"))
    return keys.select(*KEY, F.explode(ids).alias("asset_id")).select("*", F.explode(months).alias("month"))


def in_asked_months(rows: DataFrame, keys: DataFrame, month: Column) -> DataFrame:
    """The rows of the months that any key covers. There are few months, however many keys, so they are broadcast."""
    span = F.sequence(first_of_month("date_start"), first_of_month("date_end"), F.expr("interval 1 month"))
    asked = keys.select("date_start", "date_end").distinct().select(F.explode(span).alias("_asked")).distinct()
    return rows.join(F.broadcast(asked), month == F.col("_asked"), "left_semi")


def with_months(keys: DataFrame, months: DataFrame) -> DataFrame:
    """Month rows of every key. The join is an equi join on asset and month that treats the fleet's null as a value.

    It sorts and merges: the planner takes the keys to be as small as before their ids and months are spelt out.
    """
    wanted, rows = _asset_months(keys).alias("wanted"), months.hint("merge").alias("rows")
    same = F.col("wanted.asset_id").eqNullSafe(F.col("rows.asset_id")) & (F.col("wanted.month") == F.col("rows.month"))
    others = [name for name in months.columns if name not in ("asset_id", "month")]
    return wanted.join(rows, same).select(*[F.col(f"wanted.{name}") for name in KEY], "rows.month", *others)


def add_fleet(months: DataFrame, merge: list[Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """Month rows, plus those of the whole fleet with a null asset. Rows without an asset count for the fleet only."""
    fleet = months.groupBy("month", *extra).agg(*merge).withColumn("asset_id", F.lit(None).cast("string"))
    return months.filter(F.col("asset_id").isNotNull()).unionByName(fleet)


def sums(names: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def merged_telemetry() -> list[Column]:
    added = ["days", "fault_rows", "coded_rows"] + [
        f"{name}_{part}" for name in ("energy", "availability", "wind", "irradiance") for part in ("sum", "n")
    ]
    return [
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.min("availability_min").alias("availability_min"),
        *sums(added),
    ]


def mean_of(name: str) -> Column:
    return F.try_divide(f"{name}_sum", f"{name}_n")


def means_of_months(
    months: DataFrame, before: tuple[int, ...] = BEFORE_MONTHS, after: tuple[int, ...] = AFTER_MONTHS
) -> DataFrame:
    """Seasonal means per asset out of the month rows."""

    def mean(name: str, season: tuple[int, ...]) -> Column:
        inside = F.month("month").isin(*season)
        return F.try_divide(
            F.sum(F.when(inside, F.col(f"{name}_sum"))), F.sum(F.when(inside, F.col(f"{name}_n")))
        )

    return months.groupBy("asset_id").agg(
        mean("energy", before).alias("before_energy"),
        mean("energy", after).alias("after_energy"),
        mean("availability", before).alias("before_availability"),
        mean("availability", after).alias("after_availability"),
    )

"""Reports for a whole table of requests at once, from the month tables.

Equal requests are answered once: reports are computed per distinct (ids, window) and joined back. A popular asset or
question thus costs no more than a rare one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import month_label, rounded
from ..functions.dates import windows
from .maintenance import AS_OF, CADENCE_DAYS
from .months import KEY, add_fleet, in_asked_months, mean_of, means_of_months, merged_telemetry, sums, with_months
from .seasonal import AFTER_MONTHS, DROP_FLOOR, Z_THRESHOLD, assets_in_scope, displayed_figures, flagged, scores_of_means


# Requests without ids share a few keys, so each of these is dealt into so many parts.
PARTS = 32


def hand_out(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of the distinct keys, handed to every request with that key.

    All questions about the whole fleet have one of a few keys. They are spread over several parts, and the few reports of
    such keys are copied to each part; requests with ids have keys of their own.
    """
    named = requests.filter(F.size("asset_ids") > 0).join(reports.filter(F.size("asset_ids") > 0).hint("merge"), KEY)
    part = F.pmod(F.xxhash64("request_id"), F.lit(PARTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    fleet = requests.filter(F.size("asset_ids") <= 0).withColumn("part", part)
    of_fleet = reports.filter(F.size("asset_ids") <= 0).withColumn("part", copies)
    windows_and_part = ["date_start", "date_end", "part"]
    joined = fleet.join(of_fleet.drop("asset_ids"), windows_and_part).drop("part")
    return named.unionByName(joined)


def distinct_keys(requests: DataFrame) -> DataFrame:
    return requests.select(*KEY).distinct()


def _reports(requests: DataFrame, by_key: DataFrame) -> DataFrame:
    return hand_out(requests.select("request_id", *KEY), by_key).drop(*KEY)


def telemetry_by_key_and_month(keys: DataFrame, months: DataFrame) -> DataFrame:
    """The mergeable figures of each key and month. Store the table when both reports below are made from it."""
    asked = add_fleet(in_asked_months(months, keys, F.col("month")), merged_telemetry())
    return with_months(keys, asked).groupBy(*KEY, "month").agg(*merged_telemetry())


def telemetry_by_key(keys: DataFrame, months: DataFrame, by_month: DataFrame | None = None) -> DataFrame:
    """Telemetry summary of each key, out of `telemetry_by_key_and_month` where that is given."""
    if by_month is None:
        by_month = telemetry_by_key_and_month(keys, months)
    merged = by_month.groupBy(*KEY).agg(*merged_telemetry())
    return keys.join(merged.hint("merge"), KEY, "left").select(
        *KEY,
        F.when(F.col("days").isNull(), "no_data").otherwise("ok").alias("status"),
        "first_date",
        "last_date",
        F.coalesce("days", F.lit(0)).alias("days"),
        rounded(mean_of("energy"), 2).alias("avg_energy_kwh"),
        rounded(F.col("energy_sum"), 2).alias("total_energy_kwh"),
        rounded(mean_of("availability"), 2).alias("avg_availability_pct"),
        rounded(F.col("availability_min"), 2).alias("min_availability_pct"),
        rounded(mean_of("wind"), 2).alias("avg_wind_speed_ms"),
        rounded(mean_of("irradiance"), 2).alias("avg_irradiance_wm2"),
        F.coalesce("fault_rows", F.lit(0)).alias("fault_count"),
    )


def trend_by_key(keys: DataFrame, months: DataFrame, by_month: DataFrame | None = None) -> DataFrame:
    """Means of each key and month, out of `telemetry_by_key_and_month` where that is given."""
    if by_month is None:
        by_month = telemetry_by_key_and_month(keys, months)
    return by_month.select(
        *KEY,
        month_label(F.col("month")).alias("month"),
        mean_of("energy").alias("avg_energy"),
        mean_of("availability").alias("avg_avail"),
    )


def faults_by_key(keys: DataFrame, faults: DataFrame) -> DataFrame:
    merge = [
        F.sum("fault_rows").alias("fault_rows"),
        F.min("first_event").alias("first_event"),
        F.max("last_date").alias("last_date"),
    ]
    merged = with_months(keys, add_fleet(in_asked_months(faults, keys, F.col("month")), merge, ("fault_code",))).groupBy(*KEY, "fault_code").agg(*merge)
    return merged.select(
        *KEY,
        "fault_code",
        F.col("fault_rows").alias("fault_count"),
        F.col("first_event.fault_description").alias("description"),
        F.col("first_event.date").alias("first_date"),
        "last_date",
    )


def telemetry_reports(requests: DataFrame, months: DataFrame) -> DataFrame:
    """Telemetry summary of each request (`request_id`, `asset_ids`, `date_start`, `date_end`)."""
    return _reports(requests, telemetry_by_key(distinct_keys(requests), months))


def trend_reports(requests: DataFrame, months: DataFrame) -> DataFrame:
    """Mean energy and availability per month of each request."""
    return _reports(requests, trend_by_key(distinct_keys(requests), months))


def fault_reports(requests: DataFrame, faults: DataFrame) -> DataFrame:
    """Fault codes of each request with rows, first description and date span."""
    return _reports(requests, faults_by_key(distinct_keys(requests), faults))


def maintenance_by_key(keys: DataFrame, months: DataFrame, as_of: str, cadence_days: int) -> DataFrame:
    merged = (
        with_months(keys, in_asked_months(months, keys, F.col("month")))
        .groupBy(*KEY)
        .agg(
            *sums(["events", "scheduled", "corrective", "cost_sum", "cost_n", "hours_sum"]),
            F.min("first_date").alias("first_date"),
            F.max("last_event").alias("last_event"),
        )
    )
    history = months.groupBy("asset_id").agg(F.max("last_scheduled").alias("last_scheduled"))
    due = (
        keys.select(*KEY, F.explode("asset_ids").alias("asset_id"))
        .join(history.hint("merge"), "asset_id")
        .groupBy(*KEY)
        .agg(F.max("last_scheduled").alias("last_scheduled"))
    )
    since = F.datediff(F.lit(as_of).cast("date"), F.col("last_scheduled"))
    return (
        keys.join(merged.hint("merge"), KEY, "left")
        .join(due.hint("merge"), KEY, "left")
        .select(
            *KEY,
            F.when(F.col("events").isNull(), "no_data").otherwise("ok").alias("status"),
            F.coalesce("events", F.lit(0)).alias("total_events"),
            F.col("scheduled").alias("scheduled_count"),
            F.col("corrective").alias("corrective_count"),
            rounded(F.col("cost_sum"), 2).alias("total_cost_eur"),
            rounded(F.try_divide("cost_sum", "cost_n"), 2).alias("avg_cost_eur"),
            rounded(F.col("hours_sum"), 2).alias("total_duration_hours"),
            "first_date",
            F.col("last_event.date").alias("last_maintenance_date"),
            F.col("last_event.type").alias("last_maintenance_type"),
            F.date_add("last_scheduled", cadence_days).alias("estimated_next_scheduled"),
            F.coalesce(since > cadence_days, F.lit(False)).alias("maintenance_overdue"),
        )
    )


def with_ids(requests: DataFrame) -> DataFrame:
    return requests.filter(F.size("asset_ids") > 0)


def maintenance_reports(
    requests: DataFrame, months: DataFrame, as_of: str = AS_OF, cadence_days: int = CADENCE_DAYS
) -> DataFrame:
    """Maintenance summary of each request; the due date looks at the full history. Requests without ids are errors."""
    named = with_ids(requests)
    answered = _reports(named, maintenance_by_key(distinct_keys(named), months, as_of, cadence_days))
    unnamed = requests.filter(F.size("asset_ids") <= 0).select("request_id", F.lit("error").alias("status"))
    return answered.unionByName(unnamed, allowMissingColumns=True)


def low_availability_by_window(months: DataFrame, year: int, threshold: float = 90.0) -> DataFrame:
    """Low-availability assets of every window that a question can select. The windows are a fixed short list."""
    spans = F.array(
        *[
            F.struct(
                F.make_date(F.lit(year), F.lit(first), F.lit(1)).alias("date_start"),
                F.last_day(F.make_date(F.lit(year), F.lit(last), F.lit(1))).alias("date_end"),
            )
            for first, last in windows()
        ]
    )
    covering = F.filter(spans, lambda span: (span["date_start"] <= F.col("month")) & (F.col("month") <= span["date_end"]))
    return (
        months.filter(F.year("month") == year)
        .withColumn("span", F.explode(covering))
        .groupBy("span.date_start", "span.date_end", "asset_id")
        .agg(*merged_telemetry())
        .select(
            "date_start",
            "date_end",
            "asset_id",
            rounded(mean_of("availability"), 2).alias("mean_availability_pct"),
            rounded(F.col("availability_min"), 2).alias("min_availability_pct"),
            F.col("coded_rows").alias("fault_events_in_period"),
        )
        .filter(F.col("mean_availability_pct") < threshold)
    )


def declining_by_scope(
    months: DataFrame,
    assets: DataFrame,
    locations: tuple[str | None, ...],
    z_threshold: float = Z_THRESHOLD,
    drop_floor: float = DROP_FLOOR,
) -> DataFrame:
    """Flagged assets of every location in the fixed list, and of the fleet (null `scope`)."""
    scores = scores_of_means(means_of_months(months), assets, locations)
    return flagged(scores, z_threshold, drop_floor).select("scope", "avail_drop", *displayed_figures())


def windows_with_rows(months: DataFrame, year: int) -> DataFrame:
    """The windows that a question can select in which any asset has telemetry."""
    seen = months.filter(F.year("month") == year).select("month").distinct()
    spans = F.array(
        *[
            F.struct(
                F.make_date(F.lit(year), F.lit(first), F.lit(1)).alias("date_start"),
                F.last_day(F.make_date(F.lit(year), F.lit(last), F.lit(1))).alias("date_end"),
            )
            for first, last in windows()
        ]
    )
    covering = F.filter(spans, lambda span: (span["date_start"] <= F.col("month")) & (F.col("month") <= span["date_end"]))
    return seen.select(F.explode(covering).alias("span")).select("span.*").distinct()


def scopes_with_assets(months: DataFrame, assets: DataFrame, locations: tuple[str | None, ...]) -> DataFrame:
    """The locations of the list that have an asset with telemetry, and null for the fleet."""
    seen = months.select("asset_id").distinct()
    return assets_in_scope(assets.join(seen, "asset_id", "left_semi"), locations).select("scope").distinct()


def recent_codes(found: DataFrame, faults: DataFrame, year: int) -> DataFrame:
    """`recent_fault_codes` of each flagged asset and reporting window: its codes with their first descriptions.

    A list has one entry per distinct code of one asset, so the fault catalogue bounds it.
    """
    own = faults.join(found.select("asset_id").distinct().hint("merge"), "asset_id", "left_semi")
    label = month_label(F.col("month"))
    season = own.filter(F.month("month").isin(*AFTER_MONTHS)).withColumn("comparison_month", F.lit(None).cast("string"))
    single = own.filter(F.year("month") == year).withColumn("comparison_month", label)
    codes = season.unionByName(single).groupBy("asset_id", "comparison_month", "fault_code").agg(
        F.min("first_event")["fault_description"].alias("description")
    )
    return codes.groupBy("asset_id", "comparison_month").agg(
        F.array_sort(F.collect_list(F.struct("fault_code", "description"))).alias("recent_fault_codes")
    )


def with_recent_codes(found: DataFrame, codes: DataFrame) -> DataFrame:
    """Flagged assets and windows with their fault codes, an empty list when there are none."""
    left, right = found.alias("found"), codes.hint("merge").alias("codes")
    same = (F.col("found.asset_id") == F.col("codes.asset_id")) & F.col("found.comparison_month").eqNullSafe(
        F.col("codes.comparison_month")
    )
    none = F.array().cast("array<struct<fault_code:string,description:string>>")
    return left.join(right, same, "left").select("found.*", F.coalesce("recent_fault_codes", none).alias("recent_fault_codes"))


def with_month_means(found: DataFrame, months: DataFrame, year: int) -> DataFrame:
    """Flagged assets once for each reporting window: the later season (null) and every single month."""
    month_means = months.filter(F.year("month") == year).select(
        "asset_id", month_label(F.col("month")).alias("comparison_month"), rounded(mean_of("energy"), 0).alias("reporting_avg_kwh")
    )
    labels = sorted({f"{year}-{first:02d}" for first, last in windows() if first == last})
    per_month = found.withColumn(
        "comparison_month", F.explode(F.array(*[F.lit(label) for label in labels]))
    ).join(month_means.hint("merge"), ["asset_id", "comparison_month"], "left")
    season = found.withColumn("comparison_month", F.lit(None).cast("string")).withColumn(
        "reporting_avg_kwh", F.col("post_march_avg_kwh")
    )
    return season.unionByName(per_month)

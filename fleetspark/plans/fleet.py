"""Queries over assets, telemetry and maintenance."""

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import clean, maintenance, profile, seasonal, telemetry
from .registry import Registry, shown

BEFORE = "month(date) IN (1, 2)"
AFTER = "month(date) IN (3, 4, 5, 6)"
HAS_FAULT = "fault_code IS NOT NULL AND fault_code <> ''"


def _detector_sql(facts: str, dims: str, tail: str, location: str | None = None, guarded: bool = True) -> str:
    """SQL of the detector up to a relation `scored`, followed by the tail."""
    scope = "joined"
    scoping = ""
    if location is not None:
        scoping = f""", exact_hit AS (SELECT bool_or(lower(trim(location)) = '{location.lower()}') AS hit FROM joined),
        scoped AS (SELECT joined.* FROM joined, exact_hit
                   WHERE CASE WHEN hit THEN lower(trim(location)) = '{location.lower()}'
                              ELSE contains(lower(location), '{location.lower()}') END)"""
        scope = "scoped"
    z = "({x} - {m}) / nullif({s}, 0)"
    z_ratio = z.format(x="ratio", m="ratio_mean", s="ratio_std")
    z_drop = z.format(x="avail_drop", m="drop_mean", s="drop_std")
    if guarded:
        z_ratio, z_drop = f"coalesce({z_ratio}, 0)", f"coalesce({z_drop}, 0)"
    return f"""
        WITH means AS (
            SELECT asset_id, avg(energy_kwh) FILTER (WHERE {BEFORE}) AS before_energy,
                   avg(energy_kwh) FILTER (WHERE {AFTER}) AS after_energy,
                   avg(availability_pct) FILTER (WHERE {BEFORE}) - avg(availability_pct) FILTER (WHERE {AFTER}) AS avail_drop
            FROM {facts} GROUP BY asset_id),
        joined AS (
            SELECT m.*, a.type AS asset_class, a.location, after_energy / nullif(before_energy, 0) AS ratio
            FROM means m JOIN {dims} a ON m.asset_id = a.asset_id WHERE a.type IS NOT NULL){scoping},
        complete AS (SELECT * FROM {scope} WHERE before_energy IS NOT NULL AND after_energy IS NOT NULL AND avail_drop IS NOT NULL),
        figures AS (
            SELECT *, count(*) OVER c AS peer_count, avg(ratio) OVER c AS ratio_mean, stddev_samp(ratio) OVER c AS ratio_std,
                   avg(avail_drop) OVER c AS drop_mean, stddev_samp(avail_drop) OVER c AS drop_std
            FROM complete WINDOW c AS (PARTITION BY asset_class)),
        scored AS (
            SELECT *, {z_ratio} AS z_ratio, {z_drop} AS z_drop FROM figures {"WHERE peer_count >= 3" if guarded else ""})
        {tail}
    """


def _flagged_tail(z: float, floor: float, reporting: str = "after_energy", window: str = "after season") -> str:
    return f"""
        SELECT asset_id, asset_class, {shown("z_ratio", 2)} AS z_score_ratio, {shown("z_drop", 2)} AS z_score_avail_drop,
               {shown("before_energy", 0)} AS jan_feb_avg_kwh, {shown("after_energy", 0)} AS post_march_avg_kwh,
               {shown("ratio", 3)} AS seasonal_ratio, {shown("avail_drop", 2)} AS avail_drop_pct_pts,
               '{window}' AS reporting_window, {shown(reporting, 0)} AS reporting_avg_kwh, peer_count
        FROM scored WHERE z_ratio <= {z} OR avail_drop >= {floor}
    """


def _scores(scores):
    return scores.select(
        "asset_id",
        "asset_class",
        rounded(F.col("before_energy"), 3).alias("before_energy"),
        rounded(F.col("seasonal_ratio"), 6).alias("seasonal_ratio"),
        rounded(F.col("avail_drop"), 6).alias("avail_drop"),
        rounded(F.col("z_ratio"), 6).alias("z_ratio"),
        rounded(F.col("z_avail_drop"), 6).alias("z_drop"),
        "peer_count",
    )


SCORES_TAIL = f"""
    SELECT asset_id, asset_class, {shown("before_energy", 3)} AS before_energy, {shown("ratio", 6)} AS seasonal_ratio,
           {shown("avail_drop", 6)} AS avail_drop, {shown("z_ratio", 6)} AS z_ratio, {shown("z_drop", 6)} AS z_drop, peer_count
    FROM scored
"""


def register(registry: Registry) -> None:
    """Add the fleet queries."""
    _register_seasonal(registry)
    _register_telemetry(registry)
    _register_cleaning(registry)
    _register_maintenance(registry)
    _register_profile(registry)


def _register_seasonal(registry: Registry) -> None:
    part, supplier = "part_telemetry part_assets", "supplier_telemetry supplier_assets"
    registry.add(
        "underperforming_assets",
        lambda t: seasonal.underperforming_assets(t.part_telemetry, t.part_assets),
        _detector_sql("part_telemetry", "part_assets", _flagged_tail(-1.8, 4.0)),
        part,
    )
    registry.add(
        "seasonal_scores",
        lambda t: _scores(seasonal.seasonal_scores(t.supplier_telemetry, t.supplier_assets)),
        _detector_sql("supplier_telemetry", "supplier_assets", SCORES_TAIL),
        supplier,
    )
    registry.add(
        "seasonal_scores_unguarded",
        lambda t: _scores(seasonal.seasonal_scores(t.supplier_telemetry, t.supplier_assets, guarded=False)),
        _detector_sql("supplier_telemetry", "supplier_assets", SCORES_TAIL, guarded=False),
        supplier,
    )
    registry.add(
        "underperforming_by_z",
        lambda t: seasonal.underperforming_assets(
            t.supplier_telemetry, t.supplier_assets, z_threshold=-1.0, drop_floor=0.3
        ),
        _detector_sql("supplier_telemetry", "supplier_assets", _flagged_tail(-1.0, 0.3)),
        supplier,
    )
    for name, location in (("exact", "Brand#1"), ("partial", "rand#1")):
        registry.add(
            f"underperforming_location_{name}",
            lambda t, location=location: seasonal.underperforming_assets(
                t.part_telemetry, t.part_assets, location=location, drop_floor=2.0
            ),
            _detector_sql("part_telemetry", "part_assets", _flagged_tail(-1.8, 2.0), location),
            part,
        )
    registry.add(
        "underperforming_month",
        lambda t: seasonal.underperforming_assets(
            t.part_telemetry, t.part_assets, comparison_month="1996-04", drop_floor=2.5
        ),
        _detector_sql(
            "part_telemetry",
            "part_assets",
            _flagged_tail(-1.8, 2.5, "reporting_avg", "1996-04").replace(
                "FROM scored",
                """FROM scored LEFT JOIN (SELECT asset_id AS reported, avg(energy_kwh) AS reporting_avg FROM part_telemetry
                   WHERE date BETWEEN DATE '1996-04-01' AND DATE '1996-04-30' GROUP BY 1) ON asset_id = reported""",
            ),
        ),
        part,
    )

    def flagged(t, z=-1.8, floor=2.5):
        return seasonal.flagged(seasonal.seasonal_scores(t.part_telemetry, t.part_assets), z, floor)

    found = "scored WHERE z_ratio <= -1.8 OR avail_drop >= 2.5"
    registry.add(
        "underperforming_faults",
        lambda t: seasonal.recent_faults(t.part_telemetry, flagged(t)),
        _detector_sql(
            "part_telemetry",
            "part_assets",
            f"""SELECT asset_id, fault_code, arg_min(fault_description, date) AS description FROM part_telemetry
                WHERE {AFTER} AND {HAS_FAULT} AND asset_id IN (SELECT asset_id FROM {found}) GROUP BY ALL""",
        ),
        part,
    )
    registry.add(
        "underperforming_fault_lists",
        lambda t: seasonal.with_recent_faults(flagged(t), seasonal.recent_faults(t.part_telemetry)).select(
            "asset_id",
            F.array_join(F.transform("recent_fault_codes", lambda c: F.concat_ws(":", c["fault_code"], c["description"])), ",").alias(
                "recent_fault_codes"
            ),
        ),
        _detector_sql(
            "part_telemetry",
            "part_assets",
            f"""SELECT asset_id, coalesce(string_agg(fault_code || ':' || description, ',' ORDER BY fault_code), '') AS recent_fault_codes
                FROM (SELECT asset_id FROM {found}) LEFT JOIN (
                    SELECT asset_id, fault_code, arg_min(fault_description, date) AS description FROM part_telemetry
                    WHERE {AFTER} AND {HAS_FAULT} GROUP BY ALL) USING (asset_id) GROUP BY asset_id""",
        ),
        part,
    )
    registry.add(
        "late_faults",
        lambda t: seasonal.late_fault_table(t.part_telemetry, flagged(t), "1998-03-01"),
        _detector_sql(
            "part_telemetry",
            "part_assets",
            f"""SELECT asset_id, fault_code, fault_description, count(*) AS fault_rows FROM part_telemetry
                WHERE date >= DATE '1998-03-01' AND fault_code IS NOT NULL AND fault_description IS NOT NULL
                  AND asset_id IN (SELECT asset_id FROM {found}) GROUP BY ALL""",
        ),
        part,
    )
    registry.add(
        "flagged_series",
        lambda t: seasonal.flagged_series(t.part_telemetry, flagged(t)).select(
            "asset_id", "month", rounded(F.col("avg_energy"), 4).alias("avg_energy")
        ),
        _detector_sql(
            "part_telemetry",
            "part_assets",
            f"""SELECT asset_id, strftime(date, '%Y-%m') AS month, {shown("avg(energy_kwh)", 4)} AS avg_energy FROM part_telemetry
                WHERE asset_id IN (SELECT asset_id FROM {found} ORDER BY avail_drop DESC, asset_id LIMIT 5) GROUP BY ALL""",
        ),
        part,
    )
    registry.add(
        "assets_per_location",
        lambda t: seasonal.location_asset_count(t.part_telemetry, t.part_assets),
        """SELECT location, count(DISTINCT asset_id) AS asset_count FROM part_assets
           WHERE asset_id IN (SELECT asset_id FROM part_telemetry) GROUP BY location""",
        part,
    )


SUMMARY_SQL = f"""
    CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status, min(date) AS first_date, max(date) AS last_date,
    count(*) AS days, {shown("avg(energy_kwh)", 2)} AS avg_energy_kwh, {shown("coalesce(sum(energy_kwh), 0)", 2)} AS total_energy_kwh,
    {shown("avg(availability_pct)", 2)} AS avg_availability_pct, {shown("min(availability_pct)", 2)} AS min_availability_pct,
    {shown("avg(avg_wind_speed_ms)", 2)} AS avg_wind_speed_ms, {shown("avg(irradiance_wm2)", 2)} AS avg_irradiance_wm2,
    count(*) FILTER (WHERE {HAS_FAULT}) AS fault_count
"""


def _register_telemetry(registry: Registry) -> None:
    during = "date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'"
    window = ("1996-03-01", "1996-06-30")
    registry.add(
        "telemetry_summary",
        lambda t: telemetry.telemetry_summary(telemetry.select_rows(t.part_telemetry, None, *window)),
        f"SELECT {SUMMARY_SQL} FROM part_telemetry WHERE {during}",
        "part_telemetry",
    )
    registry.add(
        "telemetry_summary_no_rows",
        lambda t: telemetry.telemetry_summary(telemetry.select_rows(t.part_telemetry, None, "2024-01-01", "2024-06-30")),
        f"SELECT {SUMMARY_SQL} FROM part_telemetry WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-06-30'",
        "part_telemetry",
    )
    registry.add(
        "telemetry_summary_per_asset",
        lambda t: telemetry.telemetry_summary(t.part_telemetry, by=["asset_id"]),
        f"SELECT asset_id, {SUMMARY_SQL} FROM part_telemetry GROUP BY asset_id",
        "part_telemetry",
    )
    registry.add(
        "telemetry_summary_selected",
        lambda t: telemetry.telemetry_summary(
            telemetry.select_rows(t.part_telemetry, t.part_assets.filter("type = 'PROMO'"), *window)
        ),
        f"SELECT {SUMMARY_SQL} FROM part_telemetry WHERE {during} AND asset_id IN (SELECT asset_id FROM part_assets WHERE type = 'PROMO')",
        "part_telemetry part_assets",
    )
    registry.add(
        "telemetry_fault_summary",
        lambda t: telemetry.fault_summary(t.part_telemetry),
        f"""SELECT fault_code, count(*) AS fault_count, arg_min(fault_description, date) AS description,
                   min(date) AS first_date, max(date) AS last_date
            FROM part_telemetry WHERE {HAS_FAULT} GROUP BY fault_code""",
        "part_telemetry",
    )
    registry.add(
        "telemetry_faults_per_asset",
        lambda t: telemetry.fault_summary(t.event_telemetry, by=["asset_id"]),
        f"""SELECT asset_id, fault_code, count(*) AS fault_count, arg_min(fault_description, date) AS description,
                   min(date) AS first_date, max(date) AS last_date
            FROM event_telemetry WHERE {HAS_FAULT} GROUP BY ALL""",
        "event_telemetry",
    )
    registry.add(
        "telemetry_monthly_trend",
        lambda t: telemetry.monthly_trend(t.supplier_telemetry, by=["asset_id"]).select(
            "asset_id",
            "month",
            rounded(F.col("avg_energy"), 4).alias("avg_energy"),
            rounded(F.col("avg_avail"), 4).alias("avg_avail"),
        ),
        f"""SELECT asset_id, strftime(date, '%Y-%m') AS month, {shown("avg(energy_kwh)", 4)} AS avg_energy,
                   {shown("avg(availability_pct)", 4)} AS avg_avail
            FROM supplier_telemetry GROUP BY ALL""",
        "supplier_telemetry",
    )
    low_sql = f"""
        SELECT asset_id, {shown("avg(availability_pct)", 2)} AS mean_availability_pct,
               {shown("min(availability_pct)", 2)} AS min_availability_pct, count(fault_code) AS fault_events_in_period
        FROM supplier_telemetry WHERE {during} GROUP BY asset_id HAVING mean_availability_pct < 94.5
    """
    registry.add(
        "low_availability",
        lambda t: telemetry.low_availability_assets(t.supplier_telemetry, *window, threshold=94.5),
        low_sql,
        "supplier_telemetry",
    )
    registry.add(
        "low_availability_count",
        lambda t: telemetry.low_availability_count(
            telemetry.low_availability_assets(t.supplier_telemetry, *window, threshold=94.5), 94.5
        ),
        f"SELECT count(*) AS low_availability_count, CAST(94.5 AS DOUBLE) AS threshold_pct FROM ({low_sql})",
        "supplier_telemetry",
    )
    registry.add(
        "fault_history",
        lambda t: telemetry.fault_history(t.part_telemetry),
        f"""SELECT asset_id, date, fault_code, fault_description, availability_pct FROM part_telemetry WHERE {HAS_FAULT}""",
        "part_telemetry",
    )
    registry.add(
        "fault_history_counts",
        lambda t: telemetry.fault_history_counts(t.part_telemetry, t.part_assets),
        f"""SELECT a.asset_id, count(fault_code) AS fault_count FROM part_assets a
            LEFT JOIN (SELECT * FROM part_telemetry WHERE {HAS_FAULT}) f ON a.asset_id = f.asset_id GROUP BY a.asset_id""",
        "part_telemetry part_assets",
    )
    registry.add(
        "combined_report",
        lambda t: telemetry.combined_report(
            telemetry.low_availability_assets(t.supplier_telemetry, *window, threshold=94.5),
            seasonal.underperforming_assets(t.supplier_telemetry, t.supplier_assets, z_threshold=-1.0, drop_floor=0.3),
        ),
        _detector_sql(
            "supplier_telemetry",
            "supplier_assets",
            f"""SELECT 'declining_energy' AS section, asset_id, CAST(NULL AS DOUBLE) AS mean_availability_pct,
                       {shown("avail_drop", 2)} AS avail_drop_pct_pts
                FROM scored WHERE z_ratio <= -1.0 OR avail_drop >= 0.3
                UNION ALL SELECT 'low_availability', asset_id, mean_availability_pct, NULL FROM ({low_sql})""",
        ),
        "supplier_telemetry supplier_assets",
    )
    registry.add(
        "result_status",
        lambda t: clean.result_status(telemetry.select_rows(t.part_telemetry, None, "2024-01-01", None), "telemetry"),
        """SELECT CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status,
                  CASE WHEN count(*) = 0 THEN 'no telemetry rows match the filters; widen the dates or check the asset id' END AS message
           FROM part_telemetry WHERE date >= DATE '2024-01-01'""",
        "part_telemetry",
    )


CLEAN_ASSETS_SQL = f"""
    cleaned AS (
        SELECT upper(trim(asset_id)) AS asset_id, name, type, location, TRY_CAST(capacity_mw AS DOUBLE) AS capacity_mw,
               manufacturer, model, TRY_CAST(install_date AS DATE) AS install_date, status,
               CASE type WHEN 'wind_turbine' THEN 'wind' WHEN 'solar_plant' THEN 'solar' END AS asset_class
        FROM raw_assets),
    assets AS (
        SELECT *, {shown("date_diff('day', install_date, DATE '2024-01-01') / 365.25", 2)} AS age_years FROM cleaned)
"""


CLEAN_TELEMETRY_SQL = """
        cleaned AS (
            SELECT upper(trim(asset_id)) AS asset_id, TRY_CAST(date AS DATE) AS date, TRY_CAST(energy_kwh AS DOUBLE) AS energy_kwh,
                   TRY_CAST(availability_pct AS DOUBLE) AS availability_pct, TRY_CAST(avg_wind_speed_ms AS DOUBLE) AS avg_wind_speed_ms,
                   nullif(TRY_CAST(irradiance_wm2 AS DOUBLE), CAST('nan' AS DOUBLE)) AS irradiance_wm2,
                   TRY_CAST(temperature_c AS DOUBLE) AS temperature_c, fault_code, fault_description
            FROM raw_telemetry WHERE TRY_CAST(date AS DATE) IS NOT NULL)
    """

CLEAN_MAINTENANCE_SQL = """
        cleaned AS (
            SELECT log_id, upper(trim(asset_id)) AS asset_id, TRY_CAST(date AS DATE) AS date, type, coalesce(description, '') AS description,
                   TRY_CAST(duration_hours AS DOUBLE) AS duration_hours, coalesce(parts_replaced, 'none') AS parts_replaced,
                   TRY_CAST(cost_eur AS DOUBLE) AS cost_eur
            FROM raw_maintenance)
    """


def _register_cleaning(registry: Registry) -> None:
    registry.add(
        "asset_clean",
        lambda t: clean.clean_assets(t.raw_assets),
        f"WITH {CLEAN_ASSETS_SQL} SELECT * FROM assets",
        "raw_assets",
    )
    registry.add(
        "asset_profile",
        lambda t: clean.asset_profile(clean.clean_assets(t.raw_assets)),
        f"""WITH {CLEAN_ASSETS_SQL} SELECT asset_class, count(*) AS asset_count,
                count(*) FILTER (WHERE install_date IS NULL) AS bad_install_dates,
                count(*) FILTER (WHERE capacity_mw IS NULL) AS bad_capacities FROM assets GROUP BY asset_class""",
        "raw_assets",
    )
    registry.add(
        "asset_labels",
        lambda t: clean.asset_label(clean.clean_assets(t.raw_assets).withColumn("capacity_mw", F.col("capacity_mw").cast("bigint"))),
        f"""WITH {CLEAN_ASSETS_SQL} SELECT asset_id, '[' || asset_id || ' | ' || name || ' | ' || replace(type, '_', ' ') || ' | ' || location
                || ' | ' || manufacturer || ' ' || model || ' | ' || coalesce(CAST(CAST(trunc(capacity_mw) AS BIGINT) AS VARCHAR), '?') || ' MW | installed '
                || coalesce(CAST(install_date AS VARCHAR), '?') || ' (' || coalesce(CAST(age_years AS VARCHAR), '?') || ' yrs) | ' || status || ']' AS label
            FROM assets""",
        "raw_assets",
    )
    registry.add(
        "asset_lookup",
        lambda t: clean.lookup_assets(t.part_assets, t.part_telemetry.filter("fault_code = 'E-1007'")),
        """SELECT * REPLACE (CAST(install_date AS VARCHAR) AS install_date) FROM part_assets
           WHERE asset_id IN (SELECT asset_id FROM part_telemetry WHERE fault_code = 'E-1007')""",
        "part_telemetry part_assets",
    )
    registry.add(
        "duplicate_keys",
        lambda t: clean.duplicate_keys(t.part_telemetry.select(F.concat_ws("/", "asset_id", "date").alias("asset_day")), "asset_day"),
        """SELECT concat(asset_id, '/', date) AS asset_day, count(*) - 1 AS surplus_rows FROM part_telemetry
           GROUP BY ALL HAVING count(*) > 1""",
        "part_telemetry",
    )
    telemetry_sql = CLEAN_TELEMETRY_SQL
    registry.add(
        "telemetry_clean",
        lambda t: clean.clean_telemetry(t.raw_telemetry),
        f"WITH {telemetry_sql} SELECT * FROM cleaned",
        "raw_telemetry",
    )
    registry.add(
        "telemetry_profile",
        lambda t: clean.telemetry_profile(clean.clean_telemetry(t.raw_telemetry)),
        f"""WITH {telemetry_sql} SELECT count(*) AS row_count, count(DISTINCT asset_id) AS asset_count, min(date) AS first_date,
                max(date) AS last_date, count(fault_code) AS fault_rows FROM cleaned""",
        "raw_telemetry",
    )
    maintenance_sql = CLEAN_MAINTENANCE_SQL
    registry.add(
        "maintenance_clean",
        lambda t: clean.clean_maintenance(t.raw_maintenance),
        f"WITH {maintenance_sql} SELECT * FROM cleaned",
        "raw_maintenance",
    )
    registry.add(
        "maintenance_profile",
        lambda t: clean.maintenance_profile(clean.clean_maintenance(t.raw_maintenance)),
        f"""WITH {maintenance_sql} SELECT count(*) AS row_count, count(DISTINCT asset_id) AS asset_count,
                count(*) FILTER (WHERE type = 'scheduled') AS scheduled_count, count(*) FILTER (WHERE type = 'corrective') AS corrective_count
            FROM cleaned""",
        "raw_maintenance",
    )
    registry.add(
        "date_range_check",
        lambda t: t.raw_maintenance.select(
            "log_id", _date_error("date", F.lit("1998-06-30")).alias("error")
        ),
        """SELECT log_id, CASE WHEN TRY_CAST(date AS DATE) IS NULL THEN 'Invalid date: ' || date
                WHEN TRY_CAST(date AS DATE) > DATE '1998-06-30' THEN 'Empty date range: ' || date || ' is after 1998-06-30' END AS error
           FROM raw_maintenance""",
        "raw_maintenance",
    )
    registry.add(
        "scalar_metadata",
        lambda t: clean.scalar_metadata(
            t.raw_assets.select("asset_id", "capacity_mw", "install_date", F.length("name").alias("name_length")),
            ["capacity_mw", "install_date", "name_length"],
        ).withColumn("name_length", F.col("name_length").cast("bigint")),
        """SELECT asset_id, coalesce(capacity_mw, '') AS capacity_mw, coalesce(install_date, '') AS install_date,
                  length(name) AS name_length FROM raw_assets""",
        "raw_assets",
    )


def _date_error(start: str, end):
    from ..functions import date_range_error

    return date_range_error(F.col(start), end)


def _register_maintenance(registry: Registry) -> None:
    as_of = "2001-07-01"
    start, end = "1998-01-01", "2000-12-31"
    inside = f"date BETWEEN DATE '{start}' AND DATE '{end}'"

    def summary_sql(keys: str) -> str:
        listed = f"{keys}, " if keys else ""
        return f"""
            SELECT {listed}count(*) FILTER (WHERE {inside}) AS total_events,
                count(*) FILTER (WHERE {inside} AND type = 'scheduled') AS scheduled_count,
                count(*) FILTER (WHERE {inside} AND type = 'corrective') AS corrective_count,
                {shown(f"coalesce(sum(cost_eur) FILTER (WHERE {inside}), 0)", 2)} AS total_cost_eur,
                {shown(f"avg(cost_eur) FILTER (WHERE {inside})", 2)} AS avg_cost_eur,
                {shown(f"coalesce(sum(duration_hours) FILTER (WHERE {inside}), 0)", 2)} AS total_duration_hours,
                min(date) FILTER (WHERE {inside}) AS first_date, max(date) FILTER (WHERE {inside}) AS last_maintenance_date,
                arg_max(type, (date, log_id)) FILTER (WHERE {inside}) AS last_maintenance_type,
                max(date) FILTER (WHERE type = 'scheduled') + 180 AS estimated_next_scheduled,
                coalesce(DATE '{as_of}' - max(date) FILTER (WHERE type = 'scheduled') > 180, false) AS maintenance_overdue
            FROM maintenance {"GROUP BY " + keys if keys else ""} HAVING total_events > 0
        """

    registry.add(
        "maintenance_summary",
        lambda t: maintenance.maintenance_summary(t.maintenance, start, end, as_of=as_of),
        summary_sql("asset_id"),
        "maintenance",
    )
    registry.add(
        "maintenance_summary_fleet",
        lambda t: maintenance.maintenance_summary(t.maintenance, start, end, by=(), as_of=as_of),
        summary_sql(""),
        "maintenance",
    )
    registry.add(
        "maintenance_due",
        lambda t: maintenance.maintenance_due(t.maintenance, as_of=as_of),
        f"""SELECT asset_id, last_scheduled, last_scheduled + 180 AS estimated_next_scheduled,
                DATE '{as_of}' - last_scheduled AS days_since, coalesce(DATE '{as_of}' - last_scheduled > 180, false) AS maintenance_overdue
            FROM (SELECT asset_id, max(date) FILTER (WHERE type = 'scheduled') AS last_scheduled FROM maintenance GROUP BY asset_id)""",
        "maintenance",
    )
    registry.add(
        "last_event",
        lambda t: maintenance.last_event(t.maintenance),
        """SELECT asset_id, max(date) AS last_maintenance_date, arg_max(type, (date, log_id)) AS last_maintenance_type
           FROM maintenance GROUP BY asset_id""",
        "maintenance",
    )
    registry.add(
        "underperforming_location_unknown",
        lambda t: seasonal.location_status(t.supplier_telemetry, t.supplier_assets, "Atlantis"),
        """SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no_data' END AS status,
                CASE WHEN count(*) = 0 THEN 'no asset at location ''Atlantis''' END AS message
            FROM supplier_assets WHERE contains(lower(location), 'atlantis') AND asset_id IN (SELECT asset_id FROM supplier_telemetry)""",
        "supplier_assets supplier_telemetry",
    )
    registry.add(
        "maintenance_events",
        lambda t: maintenance.events(t.maintenance, t.part_assets.filter("type = 'PROMO'"), start, end, 12),
        f"""SELECT log_id, asset_id, date, type, substring(description, 1, 12) AS description, 'unknown' AS technician, duration_hours, parts_replaced,
                {shown("cost_eur", 2)} AS cost_eur
            FROM maintenance WHERE {inside} AND asset_id IN (SELECT asset_id FROM part_assets WHERE type = 'PROMO')""",
        "maintenance part_assets",
    )
    registry.add(
        "codes_in_logs",
        lambda t: maintenance.codes_in_logs(t.maintenance, by=["asset_id"]),
        r"""SELECT DISTINCT asset_id, unnest(regexp_extract_all(description, '(E-\d+)', 1)) AS fault_code FROM maintenance""",
        "maintenance",
    )
    registry.add(
        "parts_frequency",
        lambda t: maintenance.parts_frequency(t.maintenance, by=["asset_id"]),
        "SELECT asset_id, parts_replaced, count(*) AS events FROM maintenance GROUP BY ALL",
        "maintenance",
    )
    totals = f"""
        SELECT CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status, count(*) AS event_count,
               count(DISTINCT asset_id) AS assets_affected, {shown("coalesce(sum(cost_eur), 0)", 2)} AS total_cost_eur
        FROM maintenance WHERE """
    registry.add(
        "search_fault_code",
        lambda t: maintenance.search_by_fault_code(t.maintenance, "e-1004"),
        totals + "regexp_matches(description, 'e-1004', 'i')",
        "maintenance",
    )
    registry.add(
        "search_fault_code_events",
        lambda t: maintenance.search_events(t.maintenance, "description", "e-100[45]"),
        f"""SELECT log_id, asset_id, date, type, substring(description, 1, 200) AS description, duration_hours, parts_replaced,
                {shown("cost_eur", 2)} AS cost_eur
            FROM maintenance WHERE regexp_matches(description, 'e-100[45]', 'i')""",
        "maintenance",
    )
    registry.add(
        "search_part",
        lambda t: maintenance.search_by_part(t.maintenance, "urgent"),
        totals + "regexp_matches(parts_replaced, 'urgent', 'i')",
        "maintenance",
    )
    registry.add(
        "search_part_no_data",
        lambda t: maintenance.search_by_part(t.maintenance, "gearbox"),
        totals + "regexp_matches(parts_replaced, 'gearbox', 'i')",
        "maintenance",
    )
    registry.add(
        "search_part_assets",
        lambda t: maintenance.assets_affected(t.maintenance, "urgent"),
        """SELECT asset_id, min(date) AS first_date, count(*) AS events FROM maintenance
           WHERE regexp_matches(parts_replaced, 'urgent', 'i') GROUP BY asset_id""",
        "maintenance",
    )


def _register_profile(registry: Registry) -> None:
    numbers = ["energy_kwh", "availability_pct", "avg_wind_speed_ms"]
    registry.add(
        "describe_telemetry",
        lambda t: profile.describe(t.part_telemetry, numbers).select(
            "column",
            "count",
            *[rounded(F.col(name), 4).alias(name) for name in ("mean", "std", "min", "max", "p25", "p50", "p75")],
        ),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "column", count({name}) AS count, {shown(f"avg({name})", 4)} AS mean,
                {shown(f"stddev_samp({name})", 4)} AS std, {shown(f"min({name})", 4)} AS min, {shown(f"max({name})", 4)} AS max,
                {shown(f"quantile_cont({name}, 0.25)", 4)} AS p25, {shown(f"quantile_cont({name}, 0.5)", 4)} AS p50,
                {shown(f"quantile_cont({name}, 0.75)", 4)} AS p75 FROM part_telemetry"""
            for name in numbers
        ),
        "part_telemetry",
    )
    registry.add(
        "histogram_capacity",
        lambda t: profile.histogram(t.part_assets, "capacity_mw"),
        """SELECT CAST(1 + least(floor((capacity_mw - low) / nullif((high - low) / 15, 0)), 14) AS BIGINT) AS bin, count(*) AS rows
           FROM part_assets, (SELECT min(capacity_mw) AS low, max(capacity_mw) AS high FROM part_assets) GROUP BY ALL""",
        "part_assets",
    )
    registry.add(
        "top_faults",
        lambda t: profile.top_faults(t.part_telemetry),
        "SELECT fault_code, count(*) AS rows FROM part_telemetry WHERE fault_code IS NOT NULL GROUP BY ALL",
        "part_telemetry",
    )
    registry.add(
        "type_split",
        lambda t: profile.value_shares(t.maintenance, "type").select(
            "type", "rows", rounded(F.col("share"), 4).alias("share")
        ),
        f"""SELECT type, count(*) AS rows, {shown("count(*) / sum(count(*)) OVER ()", 4)} AS share FROM maintenance GROUP BY type""",
        "maintenance",
    )
    registry.add(
        "value_counts_type",
        lambda t: profile.value_counts(t.part_assets, "type"),
        "SELECT type, count(*) AS rows FROM part_assets GROUP BY ALL",
        "part_assets",
    )
    registry.add(
        "value_counts_manufacturer",
        lambda t: profile.value_counts(t.part_assets, "manufacturer"),
        "SELECT manufacturer, count(*) AS rows FROM part_assets GROUP BY ALL",
        "part_assets",
    )
    registry.add(
        "monthly_cost",
        lambda t: profile.monthly_cost(t.maintenance).select("month", rounded(F.col("cost_eur"), 2).alias("cost_eur")),
        f"""SELECT strftime(date, '%Y-%m') AS month, {shown("sum(cost_eur)", 2)} AS cost_eur FROM maintenance GROUP BY ALL""",
        "maintenance",
    )
    registry.add(
        "fault_rate",
        lambda t: profile.fault_rate(t.part_telemetry).withColumn("fault_rate", rounded(F.col("fault_rate"), 6)),
        f"""SELECT count(fault_code) AS fault_rows, {shown("count(fault_code) / count(*)", 6)} AS fault_rate FROM part_telemetry""",
        "part_telemetry",
    )
    registry.add(
        "fleet_monthly",
        lambda t: profile.fleet_monthly(t.part_telemetry).select(
            "month",
            rounded(F.col("avg_energy"), 4).alias("avg_energy"),
            rounded(F.col("avg_avail"), 4).alias("avg_avail"),
        ),
        f"""SELECT strftime(date, '%Y-%m') AS month, {shown("avg(energy_kwh)", 4)} AS avg_energy, {shown("avg(availability_pct)", 4)} AS avg_avail
            FROM part_telemetry GROUP BY ALL""",
        "part_telemetry",
    )
    columns = ["asset_id", "date", "energy_kwh", "avg_wind_speed_ms", "irradiance_wm2", "fault_code", "fault_description"]
    registry.add(
        "null_counts",
        lambda t: profile.null_counts(t.part_telemetry.select(*columns)),
        "SELECT " + ", ".join(f"count(*) FILTER (WHERE {name} IS NULL) AS {name}" for name in columns) + " FROM part_telemetry",
        "part_telemetry",
    )
    registry.add(
        "telemetry_span",
        lambda t: profile.span(t.part_telemetry),
        """SELECT count(*) AS row_count, CAST(9 AS BIGINT) AS column_count, min(date) AS first_date, max(date) AS last_date,
                count(DISTINCT asset_id) AS asset_count FROM part_telemetry""",
        "part_telemetry",
    )
    registry.add(
        "asset_preview",
        lambda t: profile.preview(t.part_assets, ["install_date", "asset_id"]),
        "SELECT * FROM part_assets ORDER BY install_date, asset_id LIMIT 5",
        "part_assets",
    )

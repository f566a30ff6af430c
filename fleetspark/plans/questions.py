"""Queries over requests: intent, id resolution, and the batch reports."""

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import batch, intent, months, resolve
from ..checkpoints import materialised
from . import answering
from .registry import Registry, shown

YEAR = 1996
LOCATIONS = (None, "Northern Spain", "Galicia", "Aragon", "Spain", "Atlantis")

WINDOW_SQL = f"""
    windowed AS (
        SELECT request_id, question, lower(question) AS q,
            CASE WHEN contains(q, 'last month') THEN 6
                 WHEN contains(q, 'past 6') OR contains(q, '6 months') THEN 1
                 WHEN contains(q, 'past 3') OR contains(q, '3 months') OR contains(q, 'q2') THEN 4
                 WHEN contains(q, 'q1') THEN 1
                 WHEN contains(q, 'january') THEN 1 WHEN contains(q, 'february') THEN 2 WHEN contains(q, 'march') THEN 3
                 WHEN contains(q, 'april') THEN 4 WHEN contains(q, 'may') THEN 5 WHEN contains(q, 'june') THEN 6 ELSE 1 END AS first_month,
            CASE WHEN contains(q, 'last month') THEN 6
                 WHEN contains(q, 'past 6') OR contains(q, '6 months') THEN 6
                 WHEN contains(q, 'past 3') OR contains(q, '3 months') OR contains(q, 'q2') THEN 6
                 WHEN contains(q, 'q1') THEN 3
                 WHEN contains(q, 'january') THEN 1 WHEN contains(q, 'february') THEN 2 WHEN contains(q, 'march') THEN 3
                 WHEN contains(q, 'april') THEN 4 WHEN contains(q, 'may') THEN 5 WHEN contains(q, 'june') THEN 6 ELSE 6 END AS last_month,
            make_date({YEAR}, first_month, 1) AS date_start, last_day(make_date({YEAR}, last_month, 1)) AS date_end
        FROM questions)
"""

IDS_SQL = r"""
    mentions AS (
        SELECT request_id, unnest(found) AS id, unnest(range(len(found))) AS place
        FROM (SELECT request_id, regexp_extract_all(upper(question), '\b((?:WT|PV)-\d+)\b', 1) AS found FROM questions)),
    named AS (SELECT request_id, id, min(place) AS place FROM mentions GROUP BY ALL),
    id_lists AS (SELECT request_id, string_agg(id, ',' ORDER BY place) AS ids FROM named GROUP BY request_id)
"""

RESOLVED_SQL = """
    wanted AS (SELECT DISTINCT raw_id, upper(trim(raw_id)) AS query_id FROM {queries}),
    pairs AS (
        SELECT raw_id, asset_id, levenshtein(query_id, asset_id) AS distance
        FROM wanted JOIN {registry} ON starts_with(asset_id, regexp_extract(query_id, '^((?:WT|PV)-)', 1))
        WHERE abs(length(query_id) - length(asset_id)) <= 1),
    closest AS (SELECT raw_id, min(distance) AS distance FROM pairs WHERE distance <= 1 GROUP BY raw_id),
    resolved AS (
        SELECT w.raw_id, min(p.asset_id) AS asset_id, c.distance, count(p.asset_id) AS n_ties, count(p.asset_id) > 1 AS ambiguous
        FROM wanted w LEFT JOIN closest c ON w.raw_id = c.raw_id
        LEFT JOIN pairs p ON p.raw_id = w.raw_id AND p.distance = c.distance GROUP BY w.raw_id, c.distance)
"""

# Requests answered per asset, with their ids and window.
REQUEST_ROWS_SQL = f"""
    {WINDOW_SQL}, {IDS_SQL},
    per_asset AS (
        SELECT w.request_id, w.date_start, w.date_end, n.id AS asset_id
        FROM windowed w LEFT JOIN named n ON w.request_id = n.request_id
        WHERE n.id IS NOT NULL OR NOT regexp_matches(q, 'which assets|all assets|underperform|degraded|declining|consistent')),
    asked AS (SELECT DISTINCT request_id FROM per_asset),
    matched AS (
        SELECT request_id, t.* FROM per_asset p JOIN question_telemetry t
        ON t.date BETWEEN p.date_start AND p.date_end AND t.asset_id = p.asset_id
        UNION ALL
        SELECT request_id, t.* FROM per_asset p JOIN question_telemetry t
        ON t.date BETWEEN p.date_start AND p.date_end WHERE p.asset_id IS NULL)
"""


def per_asset_requests(t):
    """Requests of the per-asset kind in the shape of the batch reports."""
    requests = intent.with_intent(t.questions, YEAR)
    return requests.filter("kind = 'per_asset'").select(
        "request_id", F.col("mentioned_ids").alias("asset_ids"), "date_start", "date_end"
    )


TOOLS = """CASE WHEN question LIKE 'Compare%' THEN array('asset_lookup', 'telemetry_tool')
    WHEN question LIKE 'Is %' THEN array('asset_lookup', 'maintenance_tool', 'telemetry_tool')
    WHEN question LIKE 'What %' THEN array('telemetry_tool', 'maintenance_tool') ELSE array('telemetry_tool') END"""

TOOLS_SQL = TOOLS.replace("array(", "list_value(")


def _declining_sql(scopes: str) -> str:
    """SQL of the figures of every asset in each of the scopes."""
    return f"""
        scopes AS (SELECT unnest([{scopes}]) AS scope),
        means AS (
            SELECT asset_id, avg(energy_kwh) FILTER (WHERE month(date) IN (1, 2)) AS before_energy,
                avg(energy_kwh) FILTER (WHERE month(date) IN (3, 4, 5, 6)) AS after_energy,
                avg(availability_pct) FILTER (WHERE month(date) IN (1, 2)) - avg(availability_pct) FILTER (WHERE month(date) IN (3, 4, 5, 6)) AS avail_drop
            FROM question_telemetry GROUP BY asset_id),
        joined AS (
            SELECT scope, m.*, a.type AS asset_class, after_energy / nullif(before_energy, 0) AS ratio, lower(location) = lower(scope) AS exact
            FROM scopes JOIN means m ON true JOIN question_assets a ON m.asset_id = a.asset_id
            WHERE scope IS NULL OR contains(lower(location), lower(scope))),
        chosen AS (SELECT *, bool_or(exact) OVER (PARTITION BY scope) AS any_exact FROM joined),
        figures AS (
            SELECT *, count(*) OVER c AS peer_count, avg(ratio) OVER c AS rm, stddev_samp(ratio) OVER c AS rs, avg(avail_drop) OVER c AS dm,
                stddev_samp(avail_drop) OVER c AS ds
            FROM chosen WHERE (scope IS NULL OR exact = any_exact) AND before_energy + after_energy + avail_drop IS NOT NULL
            WINDOW c AS (PARTITION BY scope, asset_class)),
        scored AS (
            SELECT *, coalesce((ratio - rm) / nullif(rs, 0), 0) AS z_ratio, coalesce((avail_drop - dm) / nullif(ds, 0), 0) AS z_drop
            FROM figures WHERE peer_count >= 3)
    """


def _unpacked(t, schema: str):
    """The data of the telemetry results, by field."""
    found = request_results(t, ("telemetry_tool",)).filter("tool = 'telemetry_tool' AND data_json IS NOT NULL")
    return found.select("request_id", F.from_json("data_json", schema).alias("data")).select("request_id", "data.*")


def request_results(t, stored=answering.STORED):
    """All tool results of all requests, as JSON. The lookups and the month tables are written
    once, since many reports read them, and so are the tables that the reports of the tools in `stored` share."""
    requests = t.questions.withColumn("tools", F.expr(TOOLS))
    return answering.answer_requests(
        requests,
        materialised(resolve.lookup_requests(requests, t.question_assets)),
        t.question_assets,
        materialised(months.telemetry_months(t.question_telemetry)),
        materialised(months.fault_months(t.question_telemetry)),
        materialised(months.maintenance_months(t.question_maintenance)),
        t.question_maintenance,
        YEAR,
        threshold=95.0,
        z_threshold=-1.0,
        drop_floor=0.3,
        as_of="2001-07-01",
        stored=stored,
    )


def register(registry: Registry) -> None:
    """Add the request queries."""
    registry.add(
        "request_dates",
        lambda t: intent.with_intent(t.questions, YEAR).select("request_id", "date_start", "date_end"),
        f"WITH {WINDOW_SQL} SELECT request_id, date_start, date_end FROM windowed",
        "questions",
    )
    registry.add(
        "request_ids",
        lambda t: intent.with_intent(t.questions).select("request_id", F.array_join("mentioned_ids", ",").alias("ids")),
        f"WITH {IDS_SQL} SELECT q.request_id, coalesce(ids, '') AS ids FROM questions q LEFT JOIN id_lists l ON q.request_id = l.request_id",
        "questions",
    )
    registry.add(
        "request_intent",
        lambda t: intent.with_intent(t.questions, YEAR).select(
            "request_id", "is_broad", "wants_availability", "wants_energy", "location", "comparison_month", "kind"
        ),
        rf"""WITH {WINDOW_SQL}, flags AS (
            SELECT *, regexp_matches(q, 'which assets|all assets|underperform|degraded|declining|consistent')
                      AND NOT regexp_matches(question, '(?i)\b(WT|PV)-\d+\b') AS is_broad,
                regexp_matches(q, 'availability|below 90|below 80|uptime') AS wants_availability,
                regexp_matches(q, 'underperform|declining|degraded|output|energy') AS wants_energy FROM windowed)
            SELECT request_id, is_broad, wants_availability, wants_energy,
                CASE WHEN contains(q, 'galicia') THEN 'Galicia' WHEN contains(q, 'southern spain') THEN 'Southern Spain' END AS location,
                CASE WHEN first_month = last_month THEN strftime(date_start, '%Y-%m') END AS comparison_month,
                CASE WHEN NOT is_broad THEN 'per_asset' WHEN wants_availability AND wants_energy THEN 'combined'
                     WHEN wants_availability THEN 'low_availability' ELSE 'declining_energy' END AS kind
            FROM flags""",
        "questions",
    )
    registry.add(
        "request_filters",
        lambda t: intent.with_search_filters(t.questions).select("request_id", "fault_code", "manufacturer"),
        r"""SELECT request_id, nullif(upper(regexp_extract(question, '(?i)\b(E-\d+)\b', 1)), '') AS fault_code,
                CASE WHEN contains(lower(question), 'vestas') THEN 'Vestas'
                     WHEN regexp_matches(lower(question), 'siemens|gamesa') THEN 'Siemens Gamesa'
                     WHEN regexp_matches(lower(question), 'longi|hi-mo') THEN 'LONGi Solar' END AS manufacturer
            FROM questions""",
        "questions",
    )
    registry.add(
        "fuzzy_resolve",
        lambda t: resolve.resolve_ids(t.misspelt_ids, t.named_assets),
        "WITH " + RESOLVED_SQL.format(queries="misspelt_ids", registry="named_assets") + "SELECT * FROM resolved",
        "misspelt_ids named_assets",
    )
    status_sql = f"""
        WITH {IDS_SQL}, all_ids AS (SELECT DISTINCT id AS raw_id FROM named),
        {RESOLVED_SQL.format(queries="all_ids", registry="question_assets")},
        joined AS (SELECT n.request_id, n.place, n.id, r.asset_id, r.ambiguous FROM named n JOIN resolved r ON n.id = r.raw_id),
        lists AS (
            SELECT request_id, string_agg(asset_id, ',' ORDER BY place) AS asset_ids, count(asset_id) AS n_found,
                   count(*) - count(asset_id) AS n_unknown, count(*) FILTER (WHERE ambiguous) AS ambiguous_ids,
                   string_agg('Asset ''' || id || ''' not found', '; ' ORDER BY place) FILTER (WHERE asset_id IS NULL) AS error
            FROM joined GROUP BY request_id)
        SELECT q.request_id, CASE WHEN l.request_id IS NULL THEN 'error' WHEN n_unknown = 0 THEN 'ok' WHEN n_found > 0 THEN 'partial' ELSE 'error' END AS status,
               coalesce(asset_ids, '') AS asset_ids, CASE WHEN l.request_id IS NULL THEN 'No asset id in the question' ELSE error END AS error,
               coalesce(ambiguous_ids, 0) AS ambiguous_ids
        FROM questions q LEFT JOIN lists l ON q.request_id = l.request_id
    """
    registry.add(
        "resolve_status",
        lambda t: resolve.lookup_requests(t.questions, t.question_assets).withColumn("asset_ids", F.array_join("asset_ids", ",")),
        status_sql,
        "questions question_assets",
    )
    registry.add(
        "requested_assets",
        lambda t: intent.requested_assets(
            t.questions, resolve.lookup_requests(t.questions, t.question_assets)
        ).withColumn("asset_ids", F.array_join("asset_ids", ",")),
        f"""WITH statuses AS ({status_sql}), {IDS_SQL}
            SELECT s.request_id, CASE WHEN s.asset_ids <> '' THEN s.asset_ids ELSE coalesce(l.ids, '') END AS asset_ids
            FROM statuses s LEFT JOIN id_lists l ON s.request_id = l.request_id""",
        "questions question_assets",
    )
    registry.add(
        "upstream_gate",
        lambda t: intent.upstream_gate(t.tool_results),
        """SELECT request_id, coalesce(bool_or(tool = 'asset_lookup' AND error IS NOT NULL), false) AS skipped,
               min(error) FILTER (WHERE tool = 'asset_lookup') AS reason
           FROM tool_results GROUP BY request_id""",
        "tool_results",
    )
    registry.add(
        "telemetry_per_request",
        lambda t: batch.telemetry_reports(per_asset_requests(t), months.telemetry_months(t.question_telemetry)),
        f"""WITH {REQUEST_ROWS_SQL}
            SELECT a.request_id, CASE WHEN count(m.date) = 0 THEN 'no_data' ELSE 'ok' END AS status, min(date) AS first_date, max(date) AS last_date,
                count(m.date) AS days, {shown("avg(energy_kwh)", 2)} AS avg_energy_kwh, {shown("sum(energy_kwh)", 2)} AS total_energy_kwh,
                {shown("avg(availability_pct)", 2)} AS avg_availability_pct, {shown("min(availability_pct)", 2)} AS min_availability_pct,
                {shown("avg(avg_wind_speed_ms)", 2)} AS avg_wind_speed_ms, {shown("avg(irradiance_wm2)", 2)} AS avg_irradiance_wm2,
                count(*) FILTER (WHERE fault_code <> '') AS fault_count
            FROM asked a LEFT JOIN matched m ON a.request_id = m.request_id GROUP BY a.request_id""",
        "questions question_telemetry",
    )
    registry.add(
        "faults_per_request",
        lambda t: batch.fault_reports(per_asset_requests(t), months.fault_months(t.question_telemetry)),
        f"""WITH {REQUEST_ROWS_SQL}
            SELECT request_id, fault_code, count(*) AS fault_count, arg_min(fault_description, date) AS description,
                   min(date) AS first_date, max(date) AS last_date
            FROM matched WHERE fault_code <> '' GROUP BY ALL""",
        "questions question_telemetry",
    )
    registry.add(
        "trend_per_request",
        lambda t: batch.trend_reports(per_asset_requests(t), months.telemetry_months(t.question_telemetry)).withColumns(
            {"avg_energy": F.round(F.col("avg_energy") + 1e-9, 4), "avg_avail": F.round(F.col("avg_avail") + 1e-9, 4)}
        ),
        f"""WITH {REQUEST_ROWS_SQL}
            SELECT request_id, strftime(date, '%Y-%m') AS month, {shown("avg(energy_kwh)", 4)} AS avg_energy, {shown("avg(availability_pct)", 4)} AS avg_avail
            FROM matched GROUP BY ALL""",
        "questions question_telemetry",
    )
    registry.add(
        "maintenance_per_request",
        lambda t: batch.maintenance_reports(
            per_asset_requests(t), months.maintenance_months(t.question_maintenance), "2001-07-01"
        ),
        f"""WITH {WINDOW_SQL}, {IDS_SQL},
            per_asset AS (
                SELECT w.request_id, w.date_start, w.date_end, n.id AS asset_id
                FROM windowed w LEFT JOIN named n ON w.request_id = n.request_id
                WHERE n.id IS NOT NULL OR NOT regexp_matches(q, 'which assets|all assets|underperform|degraded|declining|consistent')),
            asked AS (SELECT request_id, count(asset_id) AS n_ids FROM per_asset GROUP BY request_id),
            matched AS (SELECT request_id, m.* FROM per_asset p JOIN question_maintenance m ON m.date BETWEEN p.date_start AND p.date_end AND m.asset_id = p.asset_id),
            due AS (SELECT request_id, max(date) AS last_scheduled FROM per_asset p JOIN question_maintenance m ON m.asset_id = p.asset_id
                    WHERE m.type = 'scheduled' GROUP BY request_id),
            sums AS (
                SELECT request_id, count(*) AS events, count(*) FILTER (WHERE type = 'scheduled') AS scheduled, count(*) FILTER (WHERE type = 'corrective') AS corrective,
                    sum(cost_eur) AS cost, avg(cost_eur) AS avg_cost, sum(duration_hours) AS hours, min(date) AS first_date, max(date) AS last_date,
                    arg_max(type, (date, log_id)) AS last_type FROM matched GROUP BY request_id)
            SELECT a.request_id, CASE WHEN n_ids = 0 THEN 'error' WHEN events IS NULL THEN 'no_data' ELSE 'ok' END AS status,
                CASE WHEN n_ids > 0 THEN coalesce(events, 0) END AS total_events, scheduled AS scheduled_count, corrective AS corrective_count,
                {shown("cost", 2)} AS total_cost_eur, {shown("avg_cost", 2)} AS avg_cost_eur, {shown("hours", 2)} AS total_duration_hours,
                first_date, last_date AS last_maintenance_date, last_type AS last_maintenance_type, last_scheduled + 180 AS estimated_next_scheduled,
                CASE WHEN n_ids > 0 THEN coalesce(DATE '2001-07-01' - last_scheduled > 180, false) END AS maintenance_overdue
            FROM asked a LEFT JOIN sums s ON a.request_id = s.request_id LEFT JOIN due d ON a.request_id = d.request_id""",
        "questions question_maintenance",
    )
    registry.add(
        "low_availability_by_window",
        lambda t: batch.low_availability_by_window(months.telemetry_months(t.question_telemetry), YEAR, 95.0),
        f"""WITH spans AS (
                SELECT make_date({YEAR}, first_month, 1) AS date_start, last_day(make_date({YEAR}, last_month, 1)) AS date_end
                FROM (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (1, 6), (4, 6), (1, 3)) AS v(first_month, last_month))
            SELECT date_start, date_end, asset_id, {shown("avg(availability_pct)", 2)} AS mean_availability_pct,
                {shown("min(availability_pct)", 2)} AS min_availability_pct, count(fault_code) AS fault_events_in_period
            FROM spans JOIN question_telemetry ON date BETWEEN date_start AND date_end GROUP BY ALL HAVING mean_availability_pct < 95.0""",
        "question_telemetry",
    )
    registry.add(
        "declining_by_scope",
        lambda t: batch.declining_by_scope(
            months.telemetry_months(t.question_telemetry), t.question_assets, LOCATIONS, -1.0, 0.3
        ).select("scope", "asset_id", "asset_class", "z_score_ratio", "z_score_avail_drop", "seasonal_ratio", "avail_drop_pct_pts"),
        f"""WITH {_declining_sql("NULL, 'Northern Spain', 'Galicia', 'Aragon', 'Spain', 'Atlantis'")}
            SELECT scope, asset_id, asset_class, {shown("z_ratio", 2)} AS z_score_ratio, {shown("z_drop", 2)} AS z_score_avail_drop,
                {shown("ratio", 3)} AS seasonal_ratio, {shown("avail_drop", 2)} AS avail_drop_pct_pts
            FROM scored WHERE z_ratio <= -1.0 OR avail_drop >= 0.3""",
        "question_telemetry question_assets",
    )
    registry.add(
        "request_results",
        lambda t: request_results(t, ()).select("request_id", "source_index", "tool", "status", "error"),
        f"""WITH statuses AS ({status_sql}), {IDS_SQL}, plans AS (SELECT request_id, question, {TOOLS_SQL} AS tools FROM questions),
            placed AS (SELECT request_id, question, tools, unnest(tools) AS tool, unnest(range(len(tools))) + 1 AS source_index FROM plans),
            gates AS (
                SELECT p.*, s.status AS lookup_status, s.error AS lookup_error, list_contains(tools, 'asset_lookup') AND s.error IS NOT NULL AS gated,
                    regexp_matches(lower(question), 'which assets|all assets|underperform|degraded|declining|consistent') AND l.ids IS NULL AS is_broad
                FROM placed p JOIN statuses s ON p.request_id = s.request_id LEFT JOIN id_lists l ON p.request_id = l.request_id)
            SELECT request_id, source_index, tool,
                CASE WHEN tool = 'asset_lookup' THEN lookup_status WHEN gated THEN 'error' ELSE 'ok' END AS status,
                CASE WHEN tool = 'asset_lookup' THEN lookup_error WHEN gated THEN 'skipped: ' || lookup_error END AS error
            FROM gates""",
        "questions question_assets",
    )
    gates_sql = f"""
        statuses AS ({status_sql}), {WINDOW_SQL}, {IDS_SQL}, plans AS (SELECT request_id, question, {TOOLS_SQL} AS tools FROM questions),
        gates AS (
            SELECT p.request_id, p.tools, w.q, w.date_start, w.date_end, strftime(w.date_start, '%Y-%m') AS label, w.first_month = w.last_month AS single,
                CASE WHEN list_contains(tools, 'asset_lookup') AND s.asset_ids <> '' THEN s.asset_ids ELSE coalesce(l.ids, '') END AS ids,
                regexp_matches(w.q, 'which assets|all assets|underperform|degraded|declining|consistent') AND l.ids IS NULL AS is_broad,
                regexp_matches(w.q, 'availability|below 90|below 80|uptime') AS wants_availability,
                regexp_matches(w.q, 'underperform|declining|degraded|output|energy') AS wants_energy
            FROM plans p JOIN statuses s ON p.request_id = s.request_id JOIN windowed w ON p.request_id = w.request_id
            LEFT JOIN id_lists l ON p.request_id = l.request_id
            WHERE list_contains(tools, 'telemetry_tool') AND NOT (list_contains(tools, 'asset_lookup') AND s.error IS NOT NULL))"""
    registry.add(
        "batch_telemetry",
        lambda t: _unpacked(t, "status string, data struct<asset_id:string,days:bigint,avg_energy_kwh:double,total_energy_kwh:double,"
        "avg_availability_pct:double,min_availability_pct:double,fault_count:bigint,fault_codes:bigint,"
        "monthly_trend:array<struct<month:string>>>, low_availability string, declining_energy string")
        .filter("low_availability IS NULL AND declining_energy IS NULL")
        .select("request_id", "status", "data.*")
        .withColumns({"fault_codes": F.coalesce("fault_codes", F.lit(0)), "monthly_trend": F.array_join("monthly_trend.month", ",")})
        .filter("status = 'ok'"),
        f"""WITH {gates_sql},
            keys AS (SELECT DISTINCT ids, date_start, date_end FROM gates WHERE NOT is_broad),
            members AS (SELECT *, unnest(CASE WHEN ids = '' THEN [NULL] ELSE string_split(ids, ',') END) AS member FROM keys),
            matched AS (
                SELECT ids, date_start, date_end, t.* FROM members JOIN question_telemetry t ON t.asset_id = member AND t.date BETWEEN date_start AND date_end
                UNION ALL SELECT ids, date_start, date_end, t.* FROM members JOIN question_telemetry t ON t.date BETWEEN date_start AND date_end WHERE member IS NULL),
            figures AS (
                SELECT ids, date_start, date_end, count(*) AS days, {shown("avg(energy_kwh)", 2)} AS avg_energy_kwh, {shown("sum(energy_kwh)", 2)} AS total_energy_kwh,
                    {shown("avg(availability_pct)", 2)} AS avg_availability_pct, {shown("min(availability_pct)", 2)} AS min_availability_pct,
                    count(*) FILTER (WHERE fault_code <> '') AS fault_count, count(DISTINCT fault_code) FILTER (WHERE fault_code <> '') AS fault_codes,
                    array_to_string(list_sort(list(DISTINCT strftime(date, '%Y-%m'))), ',') AS monthly_trend
                FROM matched GROUP BY ALL)
            SELECT request_id, 'ok' AS status, CASE WHEN g.ids = '' THEN 'all' ELSE replace(g.ids, ',', ', ') END AS asset_id, f.* EXCLUDE (ids, date_start, date_end)
            FROM gates g JOIN figures f ON g.ids = f.ids AND g.date_start = f.date_start AND g.date_end = f.date_end WHERE NOT is_broad""",
        "questions question_assets question_telemetry",
    )
    registry.add(
        "batch_availability",
        lambda t: _unpacked(t, "low_availability struct<status:string,date_range:string,threshold_pct:double,low_availability_count:bigint,"
        "assets:array<struct<position:bigint,asset_id:string,mean_availability_pct:double,min_availability_pct:double,fault_events_in_period:bigint>>>")
        .filter("low_availability IS NOT NULL")
        .select("request_id", "low_availability.*")
        .select("*", F.explode_outer("assets").alias("one"))
        .select("*", "one.*")
        .drop("assets", "one"),
        f"""WITH {gates_sql},
            spans AS (SELECT DISTINCT date_start, date_end FROM gates WHERE is_broad AND wants_availability),
            seen AS (SELECT DISTINCT date_start, date_end FROM spans JOIN question_telemetry ON date BETWEEN date_start AND date_end),
            low AS (
                SELECT date_start, date_end, asset_id, {shown("avg(availability_pct)", 2)} AS mean_availability_pct,
                    {shown("min(availability_pct)", 2)} AS min_availability_pct, count(fault_code) AS fault_events_in_period
                FROM spans JOIN question_telemetry ON date BETWEEN date_start AND date_end GROUP BY ALL HAVING mean_availability_pct < 95.0),
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY date_start, date_end ORDER BY mean_availability_pct, asset_id) AS position,
                    count(*) OVER (PARTITION BY date_start, date_end) AS total FROM low)
            SELECT request_id, CASE WHEN s.date_start IS NULL THEN 'no_data' ELSE 'ok' END AS status, strftime(g.date_start, '%Y-%m-%d') || ' to ' || strftime(g.date_end, '%Y-%m-%d') AS date_range,
                CAST(95 AS DOUBLE) AS threshold_pct, CASE WHEN s.date_start IS NOT NULL THEN coalesce(total, 0) END AS low_availability_count,
                position, asset_id, mean_availability_pct, min_availability_pct, fault_events_in_period
            FROM gates g LEFT JOIN seen s ON g.date_start = s.date_start AND g.date_end = s.date_end
            LEFT JOIN ranked r ON g.date_start = r.date_start AND g.date_end = r.date_end AND position <= 10
            WHERE is_broad AND wants_availability""",
        "questions question_assets question_telemetry",
    )
    registry.add(
        "batch_energy",
        lambda t: _unpacked(t, "declining_energy struct<status:string,location_filter:string,ratio_threshold:double,avail_drop_floor_pct_pts:double,"
        "reporting_window:string,underperforming_count:bigint,underperforming_assets:array<struct<position:bigint,asset_id:string,asset_class:string,"
        "z_score_ratio:double,z_score_avail_drop:double,seasonal_ratio:double,avail_drop_pct_pts:double,reporting_avg_kwh:double,"
        "recent_fault_codes:array<struct<fault_code:string>>>>>")
        .filter("declining_energy IS NOT NULL")
        .select("request_id", "declining_energy.*")
        .select("*", F.explode_outer("underperforming_assets").alias("one"))
        .select("*", "one.*")
        .withColumn("recent_fault_codes", F.array_join("recent_fault_codes.fault_code", ","))
        .drop("underperforming_assets", "one"),
        f"""WITH {gates_sql},
            asked AS (
                SELECT request_id, CASE WHEN contains(q, 'galicia') THEN 'Galicia' WHEN contains(q, 'southern spain') THEN 'Southern Spain' END AS scope,
                    CASE WHEN single THEN label END AS label
                FROM gates WHERE is_broad AND (wants_energy OR NOT wants_availability)),
            {_declining_sql("NULL, 'Galicia', 'Southern Spain'")},
            flagged AS (SELECT * FROM scored WHERE z_ratio <= -1.0 OR avail_drop >= 0.3),
            ranked AS (
                SELECT *, row_number() OVER (PARTITION BY scope ORDER BY avail_drop DESC, asset_id) AS position, count(*) OVER (PARTITION BY scope) AS total FROM flagged),
            labels AS (SELECT DISTINCT label FROM asked),
            in_window AS (
                SELECT label, t.* FROM labels JOIN question_telemetry t ON CASE WHEN label IS NULL THEN month(date) IN (3, 4, 5, 6) ELSE strftime(date, '%Y-%m') = label END),
            means_in AS (SELECT label, asset_id, {shown("avg(energy_kwh)", 0)} AS reporting_avg_kwh FROM in_window GROUP BY ALL),
            codes_in AS (SELECT label, asset_id, array_to_string(list_sort(list(DISTINCT fault_code)), ',') AS codes FROM in_window WHERE fault_code <> '' GROUP BY ALL),
            places AS (SELECT DISTINCT scope FROM joined)
            SELECT request_id, CASE WHEN EXISTS (SELECT 1 FROM places p WHERE p.scope IS NOT DISTINCT FROM a.scope) THEN 'ok' ELSE 'no_data' END AS status,
                a.scope AS location_filter, CAST(-1 AS DOUBLE) AS ratio_threshold, CAST(0.3 AS DOUBLE) AS avail_drop_floor_pct_pts,
                coalesce(a.label, 'after season') AS reporting_window,
                CASE WHEN EXISTS (SELECT 1 FROM places p WHERE p.scope IS NOT DISTINCT FROM a.scope) THEN coalesce(total, 0) END AS underperforming_count,
                position, r.asset_id, asset_class, {shown("z_ratio", 2)} AS z_score_ratio, {shown("z_drop", 2)} AS z_score_avail_drop,
                {shown("ratio", 3)} AS seasonal_ratio, {shown("avail_drop", 2)} AS avail_drop_pct_pts, m.reporting_avg_kwh,
                CASE WHEN r.asset_id IS NOT NULL THEN coalesce(codes, '') END AS recent_fault_codes
            FROM asked a LEFT JOIN ranked r ON a.scope IS NOT DISTINCT FROM r.scope AND position <= 10
            LEFT JOIN means_in m ON m.asset_id = r.asset_id AND m.label IS NOT DISTINCT FROM a.label
            LEFT JOIN codes_in c ON c.asset_id = r.asset_id AND c.label IS NOT DISTINCT FROM a.label""",
        "questions question_assets question_telemetry",
    )
    # The rows of each set of telemetry requests with the same ids and window.
    matched_sql = f"""{gates_sql},
            keys AS (SELECT DISTINCT ids, date_start, date_end FROM gates WHERE NOT is_broad),
            members AS (SELECT *, unnest(CASE WHEN ids = '' THEN [NULL] ELSE string_split(ids, ',') END) AS member FROM keys),
            matched AS (
                SELECT ids, date_start, date_end, t.* FROM members JOIN question_telemetry t ON t.asset_id = member AND t.date BETWEEN date_start AND date_end
                UNION ALL SELECT ids, date_start, date_end, t.* FROM members JOIN question_telemetry t ON t.date BETWEEN date_start AND date_end WHERE member IS NULL)"""
    same_key = "g.ids = f.ids AND g.date_start = f.date_start AND g.date_end = f.date_end"
    registry.add(
        "batch_faults",
        lambda t: _unpacked(t, "data struct<note:string, fault_codes:bigint, fault_events:array<struct<position:bigint,fault_code:string,"
        "fault_count:bigint,description:string,first_date:date,last_date:date>>>")
        .select("request_id", "data.fault_codes", F.col("data.note").isNotNull().alias("is_cut"), F.explode("data.fault_events").alias("one"))
        .select("request_id", "fault_codes", "is_cut", "one.*"),
        f"""WITH {matched_sql},
            codes AS (
                SELECT ids, date_start, date_end, fault_code, count(*) AS fault_count, arg_min(fault_description, date) AS description,
                    min(date) AS first_date, max(date) AS last_date FROM matched WHERE fault_code <> '' GROUP BY ALL),
            f AS (
                SELECT *, row_number() OVER (PARTITION BY ids, date_start, date_end ORDER BY fault_code) AS position,
                    count(*) OVER (PARTITION BY ids, date_start, date_end) AS fault_codes FROM codes)
            SELECT request_id, f.fault_codes, f.fault_codes > 10 AS is_cut, position, fault_code, fault_count, description, first_date, last_date
            FROM gates g JOIN f ON {same_key} WHERE NOT is_broad AND position <= 10""",
        "questions question_assets question_telemetry",
    )
    registry.add(
        "batch_trend",
        lambda t: _unpacked(t, "data struct<monthly_trend:array<struct<month:string,avg_energy:double,avg_avail:double>>>")
        .select("request_id", F.posexplode("data.monthly_trend").alias("place", "one"))
        .select("request_id", F.col("place").cast("bigint").alias("place"), "one.*")
        .withColumns({c: rounded(F.col(c), 4) for c in ("avg_energy", "avg_avail")}),
        f"""WITH {matched_sql},
            f AS (
                SELECT ids, date_start, date_end, strftime(date, '%Y-%m') AS month, avg(energy_kwh) AS energy, avg(availability_pct) AS avail
                FROM matched GROUP BY ALL)
            SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY month) - 1 AS place, month,
                {shown("energy", 4)} AS avg_energy, {shown("avail", 4)} AS avg_avail
            FROM gates g JOIN f ON {same_key} WHERE NOT is_broad""",
        "questions question_assets question_telemetry",
    )
    asset = "asset_id:string,name:string,type:string,location:string"
    registry.add(
        "batch_lookup",
        lambda t: request_results(t, ())
        .filter("tool = 'asset_lookup'")
        .withColumns({"many": F.from_json("data_json", f"assets array<struct<{asset}>>")["assets"], "one": F.from_json("data_json", f"struct<{asset}>")})
        .withColumn("shown", F.coalesce("many", F.when(F.col("one.asset_id").isNotNull(), F.array("one"))))
        .select("request_id", "status", "error", F.col("many").isNotNull().alias("as_list"), F.posexplode_outer("shown").alias("position", "asset"))
        .select("request_id", "status", "error", "as_list", F.col("position").cast("bigint").alias("position"), "asset.*"),
        f"""WITH statuses AS ({status_sql}), plans AS (SELECT request_id, {TOOLS_SQL} AS tools FROM questions),
            split AS (
                SELECT s.*, CASE WHEN asset_ids = '' THEN [NULL] ELSE string_split(asset_ids, ',') END AS ids
                FROM statuses s JOIN plans p ON s.request_id = p.request_id WHERE list_contains(tools, 'asset_lookup')),
            places AS (SELECT *, unnest(ids) AS one, unnest(range(len(ids))) AS place FROM split)
            SELECT request_id, status, error, asset_ids <> '' AND (status <> 'ok' OR len(ids) > 1) AS as_list,
                CASE WHEN one IS NOT NULL THEN place END AS position, a.asset_id, a.name, a.type, a.location
            FROM places LEFT JOIN question_assets a ON a.asset_id = one""",
        "questions question_assets",
    )
    service_sql = gates_sql.replace("list_contains(tools, 'telemetry_tool') AND NOT", "list_contains(tools, 'maintenance_tool') AND NOT")
    registry.add(
        "batch_maintenance",
        lambda t: request_results(t, ("maintenance_tool",))
        .filter("tool = 'maintenance_tool' AND data_json IS NOT NULL")
        .select("request_id", F.from_json("data_json", "status string, message string, data struct<asset_id:string,date_range:string,total_events:bigint,"
        "scheduled_count:bigint,corrective_count:bigint,total_cost_eur:double,avg_cost_eur:double,total_duration_hours:double,last_maintenance_date:date,"
        "last_maintenance_type:string,estimated_next_scheduled:date,maintenance_overdue:boolean,fault_codes_in_logs:array<string>,"
        "parts_used:map<string,bigint>,events:array<struct<position:bigint,date:string,log_id:string,type:string>>>").alias("j"))
        .select("request_id", "j.status", "j.message", "j.data.*")
        .withColumns(
            {
                "fault_codes_in_logs": F.array_join("fault_codes_in_logs", ","),
                "parts_used": F.array_join(F.array_sort(F.transform(F.map_entries("parts_used"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ","),
                "events": F.array_join(F.transform("events", lambda e: F.concat_ws("|", e["position"], e["log_id"], e["date"], e["type"])), ","),
            }
        ),
        f"""WITH {service_sql},
            keys AS (SELECT DISTINCT ids, date_start, date_end FROM gates WHERE ids <> ''),
            members AS (SELECT *, unnest(string_split(ids, ',')) AS member FROM keys),
            logs AS (SELECT ids, date_start, date_end, m.* FROM members JOIN question_maintenance m ON m.asset_id = member AND m.date BETWEEN date_start AND date_end),
            sums AS (
                SELECT ids, date_start, date_end, count(*) AS total_events, count(*) FILTER (WHERE type = 'scheduled') AS scheduled_count,
                    count(*) FILTER (WHERE type = 'corrective') AS corrective_count, {shown("sum(cost_eur)", 2)} AS total_cost_eur,
                    {shown("avg(cost_eur)", 2)} AS avg_cost_eur, {shown("sum(duration_hours)", 2)} AS total_duration_hours, min(date) AS first_date,
                    max(date) AS last_maintenance_date, arg_max(type, (date, log_id)) AS last_maintenance_type,
                    array_to_string(list_sort(list(DISTINCT regexp_extract(description, '(E-\\d+)', 1))), ',') AS fault_codes_in_logs
                FROM logs GROUP BY ALL),
            due AS (SELECT ids, date_start, date_end, max(date) AS last_scheduled FROM members JOIN question_maintenance m ON m.asset_id = member WHERE type = 'scheduled' GROUP BY ALL),
            uses AS (SELECT ids, date_start, date_end, concat(parts_replaced, ':', count(*)) AS used FROM logs GROUP BY ids, date_start, date_end, parts_replaced),
            parts AS (SELECT ids, date_start, date_end, string_agg(used, ',' ORDER BY used) AS parts_used FROM uses GROUP BY ALL),
            placed AS (SELECT *, row_number() OVER (PARTITION BY ids, date_start, date_end ORDER BY date, log_id) AS position FROM logs),
            firsts AS (
                SELECT ids, date_start, date_end, string_agg(concat_ws('|', position, log_id, date, type), ',' ORDER BY position) AS events
                FROM placed WHERE position <= 10 GROUP BY ALL),
            f AS (
                SELECT * FROM sums JOIN parts USING (ids, date_start, date_end) JOIN firsts USING (ids, date_start, date_end)
                LEFT JOIN due USING (ids, date_start, date_end))
            SELECT request_id, CASE WHEN g.ids = '' THEN 'error' WHEN total_events IS NULL THEN 'no_data' ELSE 'ok' END AS status,
                CASE WHEN g.ids = '' THEN 'no asset id in the question' WHEN total_events IS NULL THEN 'no rows match the filters' END AS message,
                CASE WHEN total_events > 0 THEN replace(g.ids, ',', ', ') END AS asset_id, strftime(first_date, '%Y-%m-%d') || ' to ' || strftime(last_maintenance_date, '%Y-%m-%d') AS date_range,
                total_events, scheduled_count, corrective_count, total_cost_eur, avg_cost_eur, total_duration_hours, last_maintenance_date, last_maintenance_type,
                CAST(last_scheduled + 180 AS DATE) AS estimated_next_scheduled,
                CASE WHEN total_events > 0 THEN coalesce(DATE '2001-07-01' - last_scheduled > 180, false) END AS maintenance_overdue,
                fault_codes_in_logs, parts_used, events
            FROM gates g LEFT JOIN f ON {same_key}""",
        "questions question_assets question_maintenance",
    )
    # Whole results; the figures in them are checked by the batch queries above.
    registry.add("request_results_json", request_results)

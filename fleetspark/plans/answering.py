"""Tool results for a table of requests: every report that the plans of the requests ask for, as JSON."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import materialised
from ..operators.batch import (
    declining_by_scope,
    distinct_keys,
    faults_by_key,
    hand_out,
    low_availability_by_window,
    maintenance_by_key,
    recent_codes,
    scopes_with_assets,
    telemetry_by_key,
    telemetry_by_key_and_month,
    trend_by_key,
    windows_with_rows,
    with_ids,
    with_month_means,
    with_recent_codes,
)
from ..operators.intent import LOCATIONS, with_intent, with_search_filters
from ..operators.maintenance import AS_OF, CADENCE_DAYS
from ..operators.months import KEY, code_months, event_months, first_of_month, in_asked_months, part_months, with_months
from ..operators.search import (
    MIN_SCORE,
    TOP_K,
    gate_error,
    numbered_context,
    source_label,
    top_k_search,
    with_content,
)
from ..operators.seasonal import DROP_FLOOR, Z_THRESHOLD
from ..operators.shape import LIST_CAP, capped_lists


# What a list about the whole fleet depends on.
WINDOW = ["date_start", "date_end"]
SCOPE = ["location", "comparison_month"]
# The tools whose reports rest on tables that many of them share.
STORED = ("telemetry_tool", "maintenance_tool")

Keep = Callable[[DataFrame], DataFrame]


def _lazy(table: DataFrame) -> DataFrame:
    return table


def _results(reports: DataFrame, tool: str, figures: list[Column]) -> DataFrame:
    """Reports as tool results with JSON data. A report without rows carries data too: its status and its filters."""
    span = F.concat(F.col("first_date").cast("string"), F.lit(" to "), F.col("last_date").cast("string"))
    label = F.when(F.size("asset_ids") > 0, F.array_join("asset_ids", ", ")).otherwise("all")
    found = F.struct(label.alias("asset_id"), span.alias("date_range"), *figures)
    payload = F.when(
        F.col("status") == "ok", F.to_json(F.struct("status", found.alias("data")))
    ).otherwise(F.to_json(F.struct("status", F.lit("no rows match the filters").alias("message"), F.struct(*KEY).alias("filters"))))
    return reports.select(
        "request_id",
        "places",
        F.lit(tool).alias("tool"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        payload.alias("data_json"),
    )


def telemetry_results(
    requests: DataFrame, months: DataFrame, faults: DataFrame, list_cap: int = LIST_CAP, keep: Keep = _lazy
) -> DataFrame:
    """Telemetry reports as tool results, with the fault codes (cut, with their number) and the monthly trend.

    `keep` stores the tables that are read more than once, so that none is planned and computed again for each use.
    """
    keys = keep(distinct_keys(requests))
    fault_columns = ["fault_code", "fault_count", "description", "first_date", "last_date"]
    codes = keep(faults_by_key(keys, faults))
    fault_lists = capped_lists(codes, KEY, [F.col("fault_code")], fault_columns, list_cap).select(
        *KEY, F.col("items").alias("fault_events"), F.col("total_count").alias("fault_codes"), F.col("note")
    )
    by_month = keep(telemetry_by_key_and_month(keys, months))
    # A window has six months at most, which bounds this list.
    trends = (
        trend_by_key(keys, months, by_month)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("month", "avg_energy", "avg_avail"))).alias("monthly_trend"))
    )
    by_key = keep(
        telemetry_by_key(keys, months, by_month).join(fault_lists.hint("merge"), KEY, "left").join(trends.hint("merge"), KEY, "left")
    )
    names = [
        "days",
        "avg_energy_kwh",
        "total_energy_kwh",
        "avg_availability_pct",
        "min_availability_pct",
        "avg_wind_speed_ms",
        "avg_irradiance_wm2",
        "fault_count",
        "fault_events",
        "fault_codes",
        "note",
        "monthly_trend",
    ]
    return _results(hand_out(requests.select("request_id", "places", *KEY), by_key), "telemetry_tool", [F.col(n) for n in names])


def maintenance_results(
    requests: DataFrame,
    months: DataFrame,
    logs: DataFrame,
    as_of: str = AS_OF,
    cadence_days: int = CADENCE_DAYS,
    list_cap: int = LIST_CAP,
    keep: Keep = _lazy,
) -> DataFrame:
    """Maintenance reports as tool results, with the first events, the codes mentioned and the parts used.

    `keep` stores the tables that are read more than once.
    """
    named = with_ids(requests)
    keys = keep(distinct_keys(named))
    logs = in_asked_months(logs, keys, first_of_month("date"))
    first_events = keep(with_months(keys, event_months(logs, list_cap)).select(*KEY, "event.*"))
    columns = [name for name in first_events.columns if name not in KEY]
    # The total of the list is the event count of the report, since the table of first events is itself cut.
    event_lists = capped_lists(first_events, KEY, [F.col("date"), F.col("log_id")], columns, list_cap).select(
        *KEY, F.col("items").alias("events")
    )
    # Distinct codes and parts of one key: short lists, bounded by the catalogues of codes and parts.
    codes = (
        with_months(keys, code_months(logs))
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set("fault_code")).alias("fault_codes_in_logs"))
    )
    parts = (
        with_months(keys, part_months(logs))
        .groupBy(*KEY, "parts_replaced")
        .agg(F.sum("events").alias("uses"))
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("parts_replaced", "uses"))).alias("parts_used"))
    )
    by_key = keep(
        maintenance_by_key(keys, months, as_of, cadence_days)
        .join(event_lists.hint("merge"), KEY, "left")
        .join(codes.hint("merge"), KEY, "left")
        .join(parts.hint("merge"), KEY, "left")
        .withColumn("last_date", F.col("last_maintenance_date"))
    )
    names = [
        "total_events",
        "scheduled_count",
        "corrective_count",
        "total_cost_eur",
        "avg_cost_eur",
        "total_duration_hours",
        "last_maintenance_date",
        "last_maintenance_type",
        "estimated_next_scheduled",
        "maintenance_overdue",
        "fault_codes_in_logs",
        "parts_used",
        "events",
    ]
    answered = _results(
        hand_out(named.select("request_id", "places", *KEY), by_key), "maintenance_tool", [F.col(name) for name in names]
    )
    unnamed = requests.filter(F.size("asset_ids") <= 0).select(
        "request_id",
        "places",
        F.lit("maintenance_tool").alias("tool"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit('{"status":"error","message":"no asset id in the question"}').alias("data_json"),
    )
    return answered.unionByName(unnamed)


def list_reports(
    requests: DataFrame, rows: DataFrame, keys: list[str], order: list[Column], list_cap: int = LIST_CAP
) -> DataFrame:
    """A list for each request: at most `list_cap` rows of its key, the total, and a note when the list was cut.

    `rows` are cut per distinct key before they meet the requests. A key is one of the windows, or of the locations and
    months, that a question can select, so the lists are few and short and are broadcast; no key is too common then.
    """
    columns = [column for column in rows.columns if column not in keys]
    lists = capped_lists(rows.withColumn("list_key", F.to_json(F.struct(*keys))), "list_key", order, columns, list_cap)
    return (
        requests.withColumn("list_key", F.to_json(F.struct(*keys)))
        .join(F.broadcast(lists), "list_key", "left")
        .withColumn("total_count", F.coalesce("total_count", F.lit(0)))
        .drop("list_key")
    )


def low_availability_report(lists: DataFrame, windows: DataFrame, threshold: float) -> DataFrame:
    """The lists as reports with their window and threshold; `no_data` where nobody has telemetry in the window."""
    known = lists.join(F.broadcast(windows.withColumn("has_rows", F.lit(True))), ["date_start", "date_end"], "left")
    ok = F.col("has_rows").isNotNull()
    span = F.concat(F.col("date_start").cast("string"), F.lit(" to "), F.col("date_end").cast("string"))
    # Null fields do not appear in the JSON.
    report = F.struct(
        F.when(ok, "ok").otherwise("no_data").alias("status"),
        F.when(~ok, "no telemetry in the window").alias("message"),
        span.alias("date_range"),
        F.lit(float(threshold)).alias("threshold_pct"),
        F.when(ok, F.col("total_count")).alias("low_availability_count"),
        F.col("note"),
        F.col("items").alias("assets"),
    )
    return known.select("request_id", report.alias("low_availability"))


def declining_report(lists: DataFrame, scopes: DataFrame, z_threshold: float, drop_floor: float) -> DataFrame:
    """The lists as reports with their location and thresholds; `no_data` where no asset is at the location."""
    named, found = lists.alias("lists"), F.broadcast(scopes.withColumn("has_assets", F.lit(True))).alias("scopes")
    known = named.join(found, F.col("lists.location").eqNullSafe(F.col("scopes.scope")), "left")
    ok = F.col("has_assets").isNotNull()
    report = F.struct(
        F.when(ok, "ok").otherwise("no_data").alias("status"),
        F.when(~ok, F.concat(F.lit("no asset at location "), F.coalesce("location", F.lit("(any)")))).alias("message"),
        F.col("location").alias("location_filter"),
        F.lit(float(z_threshold)).alias("ratio_threshold"),
        F.lit(float(drop_floor)).alias("avail_drop_floor_pct_pts"),
        F.coalesce("comparison_month", F.lit("after season")).alias("reporting_window"),
        F.when(ok, F.col("total_count")).alias("underperforming_count"),
        F.col("note"),
        F.col("items").alias("underperforming_assets"),
    )
    return known.select("request_id", report.alias("declining_energy"))


def _key_reports(requests: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of requests as requests of their own, known by the key."""
    return requests.select(_list_key(keys).alias("request_id"), *keys).distinct()


def _list_key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys))


def broad_results(
    wants_low: DataFrame, low: DataFrame, wants_energy: DataFrame, declining: DataFrame, tool: str, keep: Keep = _lazy
) -> DataFrame:
    """Results of questions about the whole fleet; a question about both lists receives both in one result.

    Requests of either kind meet by their keys alone. The reports are one for each window, or location and month; their JSON is
    written once for each pair of keys that some request has, a few hundred at most, and broadcast, so no list is shuffled.
    """
    # A fixed number of parts: the rows are narrow, and would come together in one task that takes up all the JSON.
    parts = int(low.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = wants_low.select("request_id", "places", _list_key(WINDOW).alias("low_key")).repartition(parts, "request_id")
    second = wants_energy.select("request_id", F.col("places").alias("_places"), _list_key(SCOPE).alias("declining_key"))
    both = first.join(second.repartition(parts, "request_id").hint("merge"), "request_id", "full_outer").select(
        "request_id", F.coalesce("places", "_places").alias("places"), "low_key", "declining_key"
    )
    texts = keep(
        both.select("low_key", "declining_key")
        .distinct()
        .join(F.broadcast(low.withColumnRenamed("request_id", "low_key")), "low_key", "left")
        .join(F.broadcast(declining.withColumnRenamed("request_id", "declining_key")), "declining_key", "left")
        .select("low_key", "declining_key", F.to_json(F.struct("low_availability", "declining_energy")).alias("data_json"))
    )
    asked, told = both.alias("asked"), F.broadcast(texts).alias("told")
    same = F.col("asked.low_key").eqNullSafe(F.col("told.low_key")) & F.col("asked.declining_key").eqNullSafe(F.col("told.declining_key"))
    return asked.join(told, same).select(
        "request_id",
        "places",
        F.lit(tool).alias("tool"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        "data_json",
    )


def lookup_results(lookups: DataFrame, assets: DataFrame) -> DataFrame:
    """Outcome of the id lookup as tool results: the asset, or the list of assets. A partial lookup also has an error.

    The assets are put together once per distinct list of ids; a list holds the ids of one question only.
    """
    found = lookups.filter(F.size("asset_ids") > 0)
    wanted = found.select("asset_ids").distinct().select("asset_ids", F.posexplode("asset_ids").alias("place", "asset_id"))
    shown = [
        F.col(name).cast("string").alias(name) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(name)
        for name, kind in assets.dtypes
    ]
    rows = (
        wanted.join(assets.select(*shown), "asset_id")
        .groupBy("asset_ids")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*assets.columns).alias("asset")))).alias("rows"))
        .select("asset_ids", F.transform("rows", lambda row: row["asset"]).alias("assets"))
    )
    single = (F.size("assets") == 1) & (F.col("status") == "ok")
    data = F.when(single, F.to_json(F.get("assets", F.lit(0)))).otherwise(F.to_json(F.struct("assets")))
    # Requests without ids have no assets to meet, and would all share one key.
    none = F.lit(None).cast(rows.schema["assets"].dataType)
    with_assets = found.join(rows.hint("merge"), "asset_ids", "left").unionByName(
        lookups.filter((F.size("asset_ids") <= 0) | F.col("asset_ids").isNull()).withColumn("assets", none)
    )
    return with_assets.select(
        "request_id",
        "places",
        F.lit("asset_lookup").alias("tool"),
        "status",
        "error",
        F.when(F.col("assets").isNotNull(), data).alias("data_json"),
    )


def search_results(contexts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Numbered contexts, null where nothing was found, as tool results: the context, or the error of the gate."""
    error = gate_error(F.col("best_score"), min_score)
    return contexts.withColumn("error", error).select(
        "request_id",
        F.lit("rag_tool").alias("tool"),
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
        "error",
        F.when(F.col("error").isNull(), F.to_json(F.struct("context", "chunks_used", "best_score"))).alias("data_json"),
    )


def manual_results(
    requests: DataFrame,
    index: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    k: int = TOP_K,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Search the chunk index for every request, as tool results with the numbered context.

    `embed` adds an `embedding` to a table with a `question`, in the space of the index. A fault code or manufacturer in
    the question narrows its search. Equal questions are searched once.
    """
    keyed = requests.select("request_id", "question").withColumn("query_id", F.md5("question"))
    asked = embed(with_search_filters(keyed.select("query_id", "question").dropDuplicates(["query_id"])))
    hits = top_k_search(index, asked, k, ("fault_code", "manufacturer"))
    shown = with_content(hits, index, ["page_content", "chunk_type", "fault_code", "manufacturer", "model"])
    label = source_label(F.col("fault_code"), F.col("manufacturer"), F.col("model"), F.col("chunk_type"))
    contexts = keyed.join(numbered_context(shown, label), "query_id", "left")
    return search_results(contexts, min_score)


def skipped_results(requests: DataFrame, lookups: DataFrame, tool: str) -> DataFrame:
    """Results of requests that are not answered because their id lookup reported an error."""
    reason = F.concat(F.lit("skipped: "), F.col("error"))
    return requests.select("request_id", "places").join(lookups.hint("merge"), "request_id").select(
        "request_id",
        "places",
        F.lit(tool).alias("tool"),
        F.lit("error").alias("status"),
        reason.alias("error"),
        F.lit(None).cast("string").alias("data_json"),
    )


def answer_requests(
    requests: DataFrame,
    lookups: DataFrame,
    assets: DataFrame,
    telemetry_by_month: DataFrame,
    faults_by_month: DataFrame,
    maintenance_by_month: DataFrame,
    logs: DataFrame,
    year: int = 2024,
    locations: tuple[str, ...] = LOCATIONS,
    threshold: float = 90.0,
    z_threshold: float = Z_THRESHOLD,
    drop_floor: float = DROP_FLOOR,
    as_of: str = AS_OF,
    searched: DataFrame | None = None,
    list_cap: int = LIST_CAP,
    stored: tuple[str, ...] = STORED,
) -> DataFrame:
    """Tool results of a table of requests: `request_id`, `source_index`, `tool`, `status`, `error`, `data_json`.

    `requests` has `request_id`, `question` and the planned `tools`. `lookups` is the output of `lookup_requests`; it is
    used where the plan has a lookup, and an error there skips the telemetry and maintenance of the request. The month
    tables come from `telemetry_months`, `fault_months` and `maintenance_months`; store or materialise them, since several
    reports read them. `logs` is the maintenance log itself, for the event lists. `searched` holds the
    `manual_results`, if any. Lists show at most `list_cap` rows and tell their total. Sources are numbered in the order of the plan.

    The requests with their intent are written once to the checkpoint folder, as every kind of report starts from them. So are
    the tables that the reports of the tools in `stored` share, step by step: as one plan they would be computed again for each
    use, in hundreds of stages that the driver holds at once. The results are the same whatever is stored; a caller that keeps
    only the results of some tools names those.

    Tables of requests, and of their keys, are joined by sort and merge. Compressed as they are, the planner would take them to
    be small enough to send through the driver.
    """
    telemetry_keep, service_keep = (materialised if tool in stored else _lazy for tool in STORED)
    asked = with_intent(requests.filter(F.col("request_id").isNotNull()), year, locations)
    looked_up = F.array_contains("tools", "asset_lookup")
    found = lookups.select(
        "request_id", F.col("asset_ids").alias("resolved"), F.col("error").alias("lookup_error")
    )
    # Each row knows the plans of all rows with its id, so that results are numbered without meeting the plans again.
    same_id = Window.partitionBy("request_id")
    joined = materialised(
        asked.join(found.hint("merge"), "request_id", "left").select(
            "request_id",
            "tools",
            "kind",
            *WINDOW,
            *SCOPE,
            (looked_up & F.col("lookup_error").isNotNull()).alias("gated"),
            F.when(looked_up & (F.size("resolved") > 0), F.col("resolved")).otherwise(F.col("mentioned_ids")).alias("asset_ids"),
            F.collect_list(F.array_distinct("tools")).over(same_id).alias("plans"),
            F.row_number().over(same_id.orderBy(F.desc_nulls_last(looked_up))).alias("nth"),
        )
    )

    def placed(rows: DataFrame, tool: str) -> DataFrame:
        """The rows with `places`, where the plans of their id have the tool."""
        own = F.filter("plans", lambda plan: F.array_contains(plan, tool))
        return rows.withColumn("places", F.transform(own, lambda plan: F.array_position(plan, tool).cast("bigint")))

    def planned(tool: str, gated: bool) -> DataFrame:
        return placed(joined.filter(F.array_contains("tools", tool) & (F.col("gated") == gated)), tool)

    telemetry = planned("telemetry_tool", gated=False)
    per_asset = telemetry.filter("kind = 'per_asset'").select("request_id", "places", *KEY)
    wants_low = telemetry.filter("kind IN ('low_availability', 'combined')").select("request_id", "places", *WINDOW)
    wants_energy = telemetry.filter("kind IN ('declining_energy', 'combined')").select("request_id", "places", *SCOPE)
    low = list_reports(
        _key_reports(wants_low, WINDOW),
        telemetry_keep(low_availability_by_window(telemetry_by_month, year, threshold)),
        WINDOW,
        [F.col("mean_availability_pct"), F.col("asset_id")],
        list_cap,
    )
    scopes = (None, *locations)
    found = telemetry_keep(declining_by_scope(telemetry_by_month, assets, scopes, z_threshold, drop_floor))
    by_window = telemetry_keep(
        with_recent_codes(
            with_month_means(found, telemetry_by_month, year), recent_codes(found, faults_by_month, year)
        ).withColumnRenamed("scope", "location")
    )
    declining = list_reports(
        _key_reports(wants_energy, SCOPE), by_window, SCOPE, [F.desc("avail_drop"), F.col("asset_id")], list_cap
    )
    service = planned("maintenance_tool", gated=False).select("request_id", "places", *KEY)
    # One row for each id whose plan has a lookup.
    looking_up = placed(joined.filter(looked_up & (F.col("nth") == 1)), "asset_lookup").select("request_id", "places")
    parts = [
        lookup_results(lookups.join(looking_up.hint("merge"), "request_id"), assets),
        telemetry_results(per_asset, telemetry_by_month, faults_by_month, list_cap, telemetry_keep),
        broad_results(
            wants_low,
            telemetry_keep(low_availability_report(low, windows_with_rows(telemetry_by_month, year), threshold)),
            wants_energy,
            telemetry_keep(
                declining_report(declining, scopes_with_assets(telemetry_by_month, assets, scopes), z_threshold, drop_floor)
            ),
            "telemetry_tool",
            telemetry_keep,
        ),
        maintenance_results(service, maintenance_by_month, logs, as_of, list_cap=list_cap, keep=service_keep),
        skipped_results(planned("telemetry_tool", gated=True), lookups, "telemetry_tool"),
        skipped_results(planned("maintenance_tool", gated=True), lookups, "maintenance_tool"),
    ]
    if searched is not None:
        searching = joined.filter(F.array_contains("tools", "rag_tool")).select("request_id", "plans").distinct()
        parts.append(searched.join(placed(searching, "rag_tool").drop("plans"), "request_id"))
    return concat_results(*parts).select(
        "request_id", F.explode("places").alias("source_index"), "tool", "status", "error", "data_json"
    )


def concat_results(*parts: DataFrame) -> DataFrame:
    """All tool results in one table."""
    return reduce(DataFrame.unionByName, parts)

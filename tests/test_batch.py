import json
from datetime import date
from functools import partial

from pyspark.sql import functions as F

from fleetspark.checkpoints import materialised
from fleetspark.functions.vectors import embed_hashed
from fleetspark.operators import batch, maintenance, months, resolve, seasonal, telemetry
from fleetspark.plans import answering

FACT = (
    "asset_id string, date date, energy_kwh double, availability_pct double, avg_wind_speed_ms double, "
    "irradiance_wm2 double, fault_code string, fault_description string"
)
LOG = (
    "log_id bigint, asset_id string, date date, type string, description string, duration_hours double, "
    "parts_replaced string, cost_eur double"
)


def tables(spark):
    ids = [f"WT-{n:03d}" for n in range(1, 15)]
    facts = []
    for n, one in enumerate(ids):
        for month in range(1, 7):
            fault = ("E-1", "hot") if month == 4 and n % 2 else (None, None)
            avail = 99.0 - (12.0 if month > 2 and n == 3 else 0.0) - (20.0 if n > 1 else 0.0)
            facts.append((one, date(2024, month, 3), 100.0 + n, avail, 5.0, None, *fault))
    logs = [
        (1, "WT-001", date(2023, 1, 1), "scheduled", "s", 1.0, "none", 5.0),
        (2, "WT-001", date(2024, 5, 1), "corrective", "saw E-7", 2.0, "none", 7.0),
    ]
    assets = [(one, "wind", "Galicia" if n < 7 else "Aragon") for n, one in enumerate(ids)]
    return (
        spark.createDataFrame(assets, "asset_id string, type string, location string"),
        spark.createDataFrame(facts, FACT),
        spark.createDataFrame(logs, LOG),
    )


def answered(spark, *requests):
    assets, facts, logs = tables(spark)
    asked = spark.createDataFrame(list(enumerate_requests(requests)), "request_id bigint, question string, tools array<string>")
    found = answering.answer_requests(
        asked,
        resolve.lookup_requests(asked, assets),
        assets,
        months.telemetry_months(facts),
        months.fault_months(facts),
        months.maintenance_months(logs),
        logs,
    )
    rows = {}
    for row in found.collect():
        assert (row.request_id, row.source_index) not in rows
        rows[(row.request_id, row.source_index)] = row
    return rows


def enumerate_requests(requests):
    for number, (question, tools) in enumerate(requests):
        yield number, question, tools


def test_every_kind_of_request(spark):
    found = answered(
        spark,
        ("energy of WT-001 in April?", ["asset_lookup", "telemetry_tool"]),
        ("Which assets are below 90 uptime?", ["telemetry_tool"]),
        ("Which assets are declining in availability in galicia last month?", ["telemetry_tool"]),
        ("maintenance of WT-001 and WT-777", ["asset_lookup", "maintenance_tool"]),
        ("maintenance of wt-001", ["asset_lookup", "maintenance_tool", "telemetry_tool"]),
        ("maintenance of everything", ["maintenance_tool"]),
        ("energy of the fleet in April", ["telemetry_tool"]),
    )
    assert {key: (row.tool, row.status) for key, row in found.items()} == {
        (0, 1): ("asset_lookup", "ok"),
        (0, 2): ("telemetry_tool", "ok"),
        (1, 1): ("telemetry_tool", "ok"),
        (2, 1): ("telemetry_tool", "ok"),
        (3, 1): ("asset_lookup", "partial"),
        (3, 2): ("maintenance_tool", "error"),
        (4, 1): ("asset_lookup", "ok"),
        (4, 2): ("maintenance_tool", "ok"),
        (4, 3): ("telemetry_tool", "ok"),
        (5, 1): ("maintenance_tool", "ok"),
        (6, 1): ("telemetry_tool", "ok"),
    }
    data = {key: json.loads(row.data_json) for key, row in found.items() if row.data_json}
    assert data[0, 2]["data"]["days"] == 1 and data[0, 2]["data"]["avg_energy_kwh"] == 100.0
    assert data[1, 1]["low_availability"]["low_availability_count"] == 12
    assert data[1, 1]["low_availability"]["date_range"] == "2024-01-01 to 2024-06-30"
    assert len(data[1, 1]["low_availability"]["assets"]) == 10
    assert data[1, 1]["low_availability"]["note"] == "list truncated: showing top 10 of 12"
    assert "declining_energy" not in data[1, 1]
    declining = data[2, 1]["declining_energy"]["underperforming_assets"]
    assert [item["asset_id"] for item in declining] == ["WT-004"] and declining[0]["avail_drop_pct_pts"] == 12.0
    assert data[2, 1]["low_availability"]["low_availability_count"] == 12
    assert data[2, 1]["declining_energy"]["location_filter"] == "Galicia" and data[2, 1]["declining_energy"]["status"] == "ok"
    assert found[3, 2].error == "skipped: Asset 'WT-777' not found" and (3, 2) not in data
    assert [one["asset_id"] for one in data[3, 1]["assets"]] == ["WT-001"]
    assert data[0, 1] == {"asset_id": "WT-001", "type": "wind", "location": "Galicia"}
    assert data[4, 2]["data"]["total_events"] == 1 and data[4, 2]["data"]["maintenance_overdue"] is True
    service = data[4, 2]["data"]
    assert [event["log_id"] for event in service["events"]] == [2] and service["parts_used"] == {"none": 1}
    assert service["fault_codes_in_logs"] == ["E-7"] and service["date_range"] == "2024-05-01 to 2024-05-01"
    assert data[5, 1] == {"status": "error", "message": "no asset id in the question"}
    assert data[6, 1]["data"]["asset_id"] == "all"
    assert [one["fault_code"] for one in data[6, 1]["data"]["fault_events"]] == ["E-1"]
    assert [one["month"] for one in data[0, 2]["data"]["monthly_trend"]] == ["2024-04"]
    assert data[6, 1]["data"]["days"] == 14 and data[6, 1]["data"]["fault_count"] == 7


def test_month_tables_give_the_same_figures_as_the_facts(spark, rows):
    assets, facts, logs = tables(spark)
    by_month = months.telemetry_months(facts)
    direct = seasonal.seasonal_scores(facts, assets).select("asset_id", "seasonal_ratio", "avail_drop")
    merged = seasonal.scores_of_means(months.means_of_months(by_month), assets).select("asset_id", "seasonal_ratio", "avail_drop")
    assert rows(direct) == rows(merged)
    low = batch.low_availability_by_window(by_month, 2024).filter(
        (F.col("date_start") == F.lit("2024-04-01").cast("date")) & (F.col("date_end") == F.lit("2024-06-30").cast("date"))
    )
    assert rows(low.drop("date_start", "date_end")) == rows(
        telemetry.low_availability_assets(facts, "2024-04-01", "2024-06-30")
    )
    request = spark.createDataFrame(
        [(1, ["WT-001"], date(2024, 1, 1), date(2024, 6, 30))],
        "request_id bigint, asset_ids array<string>, date_start date, date_end date",
    )
    report = batch.maintenance_reports(request, months.maintenance_months(logs)).first()
    summary = maintenance.maintenance_summary(logs, "2024-01-01", "2024-06-30").first()
    for name in ("total_events", "total_cost_eur", "last_maintenance_type", "estimated_next_scheduled", "maintenance_overdue"):
        assert report[name] == summary[name]


def test_rows_without_an_asset_count_for_the_fleet_only(spark):
    _, facts, _ = tables(spark)
    lost = spark.createDataFrame([(None, date(2024, 1, 3), 1.0, 1.0, None, None, None, None)], FACT)
    fleet = spark.createDataFrame(
        [(1, [], date(2024, 1, 1), date(2024, 1, 31))],
        "request_id bigint, asset_ids array<string>, date_start date, date_end date",
    )
    by_month = months.telemetry_months(facts.unionByName(lost))
    assert batch.telemetry_reports(fleet, by_month).first().days == 15


def test_equal_requests_are_answered_once(spark):
    _, facts, _ = tables(spark)
    requests = spark.range(1000).select(
        F.col("id").alias("request_id"),
        F.array(F.lit("WT-002")).alias("asset_ids"),
        F.lit("2024-01-01").cast("date").alias("date_start"),
        F.lit("2024-06-30").cast("date").alias("date_end"),
    )
    reports = batch.telemetry_reports(requests, months.telemetry_months(facts))
    assert reports.count() == 1000 and reports.select("days").distinct().collect()[0].days == 6


def test_manual_results(spark):
    words = ["gearbox oil overheating", "inverter filter temperature", "gearbox oil pump"]
    index = embed_hashed(
        spark.createDataFrame(
            [(f"c{i}", text, "fault_code", f"E-{i}", "Vestas" if i else "LONGi Solar", "M") for i, text in enumerate(words)],
            "id string, page_content string, chunk_type string, fault_code string, manufacturer string, model string",
        ),
        64,
    )
    asked = spark.createDataFrame(
        [(1, "gearbox oil"), (2, "vestas gearbox oil"), (3, "e-9 gearbox oil"), (4, "unrelated words"), (5, "gearbox oil")],
        "request_id bigint, question string",
    )
    embed = partial(embed_hashed, dims=64, content="question")
    found = {row.request_id: row for row in answering.manual_results(asked, index, embed, k=2).collect()}
    assert [found[i].status for i in range(1, 6)] == ["ok", "ok", "error", "error", "ok"]
    assert [found[i].error for i in (3, 4)] == ["no documents retrieved", "low relevance"]
    first, narrowed = json.loads(found[1].data_json), json.loads(found[2].data_json)
    assert first["chunks_used"] == 2 and first["context"].startswith("[Source 1] OEM Manual | LONGi Solar M | E-0 (fault_code)\n")
    assert narrowed["context"].startswith("[Source 1] OEM Manual | Vestas M | E-2") and found[3].data_json is None
    assert found[5].data_json == found[1].data_json


def test_results_are_numbered_without_meeting_the_plans_again(spark):
    assets, facts, logs = tables(spark)
    plan = ["asset_lookup", "telemetry_tool"]
    rows = [(1, "energy of WT-001 in April?", plan), (1, "energy of WT-002 in May?", ["telemetry_tool"]), (None, "energy of WT-003?", plan)]
    asked = spark.createDataFrame(rows, "request_id bigint, question string, tools array<string>")
    found = answering.answer_requests(
        asked, resolve.lookup_requests(asked, assets), assets, months.telemetry_months(facts), months.fault_months(facts),
        months.maintenance_months(logs), logs,
    )
    # Rows of one id meet each other's lookups and plans: two lookups, each with two plans; four readings, each with four plans.
    counts = {(r.tool, r.source_index): r["count"] for r in found.groupBy("tool", "source_index").count().collect()}
    assert counts == {("asset_lookup", 1): 4, ("telemetry_tool", 1): 8, ("telemetry_tool", 2): 8}
    assert found.filter("request_id IS NULL").count() == 0
    # The results are not shuffled: above the reports, no join carries their JSON.
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert "Join" not in top


def test_only_months_that_a_key_covers_meet_the_keys(spark):
    _, facts, _ = tables(spark)
    keys = spark.createDataFrame([(["WT-001"], date(2024, 2, 1), date(2024, 3, 31))], "asset_ids array<string>, date_start date, date_end date")
    kept = months.in_asked_months(months.telemetry_months(facts), keys, F.col("month"))
    assert {r.month for r in kept.select("month").distinct().collect()} == {date(2024, 2, 1), date(2024, 3, 1)}


def test_results_are_planned_in_few_stages_and_send_no_table_of_requests_through_the_driver(spark):
    assets, facts, logs = tables(spark)
    both, all_three = ["asset_lookup", "telemetry_tool"], ["asset_lookup", "maintenance_tool", "telemetry_tool"]
    questions = [
        ("energy of WT-001 in April?", both),
        ("energy of WT-777?", all_three),
        ("maintenance of WT-001 and WT-002", all_three),
        ("energy of the fleet in April", ["telemetry_tool"]),
        ("Which assets are below 90 uptime?", ["telemetry_tool"]),
        ("Which assets are declining in availability in galicia last month?", ["telemetry_tool"]),
        ("Which assets underperform in q1?", ["telemetry_tool"]),
    ]
    asked = spark.createDataFrame(list(enumerate_requests(questions)), "request_id bigint, question string, tools array<string>")

    lookups = materialised(resolve.lookup_requests(asked, assets))
    folded = [months.telemetry_months(facts), months.fault_months(facts), months.maintenance_months(logs)]
    folded = [materialised(table) for table in folded]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = answering.answer_requests(asked, lookups, assets, *folded, logs)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # As one plan there were 150 shuffles and 90 broadcast joins, those of the requests and their keys among them.
    assert plan.count("Exchange hashpartitioning") < 40 and plan.count("BroadcastHashJoin") < 10
    assert found.count() == sum(len(plan) for _, plan in questions)

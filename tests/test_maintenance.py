from datetime import date, timedelta

from fleetspark.operators import maintenance

LOG = (
    "log_id string, asset_id string, date date, type string, description string, duration_hours double, "
    "parts_replaced string, cost_eur double"
)
AS_OF = date(2024, 7, 1)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def sample(spark):
    return log(
        spark,
        ("1", "A", AS_OF - timedelta(days=180), "scheduled", "service", 2.0, "none", 10.0),
        ("2", "A", date(2024, 3, 1), "corrective", "Fault E-1001 and E-1002", 3.0, "Oil filter", None),
        ("3", "A", date(2024, 3, 1), "other", "note", None, "none", 5.5),
        ("4", "B", AS_OF - timedelta(days=181), "scheduled", "service e-1001", 1.0, "oil pump", 7.0),
        ("5", "C", None, "corrective", "undated E-1001", 1.0, "none", 1.0),
    )


def test_due_dates_at_the_edge(spark):
    due = {row.asset_id: row for row in maintenance.maintenance_due(sample(spark)).collect()}
    assert due["A"].days_since == 180 and not due["A"].maintenance_overdue
    assert due["B"].days_since == 181 and due["B"].maintenance_overdue
    assert due["C"].last_scheduled is None and due["C"].days_since is None and not due["C"].maintenance_overdue
    assert due["A"].estimated_next_scheduled == AS_OF
    everyone = maintenance.maintenance_due(sample(spark), by=()).first()
    assert everyone.last_scheduled == AS_OF - timedelta(days=180)


def test_summary_uses_the_window_but_the_full_history_for_the_due_date(spark):
    found = {row.asset_id: row for row in maintenance.maintenance_summary(sample(spark), "2024-02-01", "2024-06-30").collect()}
    assert set(found) == {"A"}
    row = found["A"]
    assert (row.total_events, row.scheduled_count, row.corrective_count) == (2, 0, 1)
    assert (row.total_cost_eur, row.avg_cost_eur, row.total_duration_hours) == (5.5, 5.5, 3.0)
    assert (row.last_maintenance_date, row.last_maintenance_type) == (date(2024, 3, 1), "other")
    assert row.estimated_next_scheduled == AS_OF and not row.maintenance_overdue


def test_summary_without_window_counts_undated_events(spark):
    found = {row.asset_id: row for row in maintenance.maintenance_summary(sample(spark)).collect()}
    assert found["C"].total_events == 1 and found["C"].last_maintenance_date is None


def test_searches(spark):
    logs = sample(spark)
    by_code = maintenance.search_by_fault_code(logs, "E-1001").first()
    assert (by_code.status, by_code.event_count, by_code.assets_affected, by_code.total_cost_eur) == ("ok", 3, 3, 8.0)
    assert maintenance.search_by_part(logs, "OIL").first().event_count == 2
    assert maintenance.search_by_part(logs, "gearbox").first().status == "no_data"
    listed = maintenance.search_events(logs, "description", "e-1001").collect()
    assert [row.log_id for row in listed] == ["4", "2", "5"] and listed[-1].date is None
    assert [row.asset_id for row in maintenance.assets_affected(logs, "oil").collect()] == ["B", "A"]


def test_codes_parts_and_last_event(spark, rows):
    logs = sample(spark)
    assert rows(maintenance.codes_in_logs(logs)) == [("E-1001",), ("E-1002",)]
    assert [tuple(row) for row in maintenance.parts_frequency(logs).collect()][0] == ("none", 3)
    last = {row.asset_id: row.last_maintenance_type for row in maintenance.last_event(logs).collect()}
    assert last == {"A": "other", "B": "scheduled", "C": None}


def test_events_are_cut_and_sorted(spark):
    listed = maintenance.events(sample(spark), ["A", "C"], description_limit=4).collect()
    assert [row.log_id for row in listed] == ["1", "2", "3", "5"]
    assert listed[1].description == "Faul" and listed[1].cost_eur is None

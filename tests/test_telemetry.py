from datetime import date

from fleetspark.operators import telemetry

FACT = (
    "asset_id string, date date, energy_kwh double, availability_pct double, avg_wind_speed_ms double, "
    "irradiance_wm2 double, fault_code string, fault_description string"
)


def fact(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def sample(spark):
    return fact(
        spark,
        ("A", date(2024, 3, 1), 10.0, 90.0, 5.0, None, "E-1", "second text"),
        ("A", date(2024, 2, 1), 20.0, 89.992, None, None, "E-1", "first text"),
        ("A", date(2024, 3, 5), None, None, 7.0, None, "", None),
        ("B", date(2024, 6, 30), 5.0, 80.0, None, None, None, None),
        ("B", date(2024, 7, 1), 6.0, 10.0, None, None, "E-2", "out"),
    )


def test_summary_counts_rows_and_faults(spark):
    row = telemetry.telemetry_summary(telemetry.select_rows(sample(spark), ["A"])).first()
    assert (row.status, row.days, row.total_energy_kwh, row.avg_energy_kwh) == ("ok", 3, 30.0, 15.0)
    assert (row.first_date, row.last_date) == (date(2024, 2, 1), date(2024, 3, 5))
    assert row.avg_wind_speed_ms == 6.0 and row.avg_irradiance_wm2 is None
    assert row.fault_count == 2


def test_empty_selection_has_a_status(spark):
    row = telemetry.telemetry_summary(telemetry.select_rows(sample(spark), ["Z"])).first()
    assert (row.status, row.days, row.avg_energy_kwh) == ("no_data", 0, None)


def test_bounds_are_closed_and_optional(spark):
    rows = sample(spark)
    assert telemetry.select_rows(rows, None, "2024-02-01", "2024-06-30").count() == 4
    assert telemetry.select_rows(rows, [], None, "2024-02-01").count() == 1
    assert telemetry.select_rows(rows).count() == 5
    wanted = spark.createDataFrame([("B",), ("B",)], "asset_id string")
    assert telemetry.select_rows(rows, wanted).count() == 2


def test_fault_summary_takes_the_earliest_description(spark):
    found = {row.fault_code: row for row in telemetry.fault_summary(sample(spark)).collect()}
    assert set(found) == {"E-1", "E-2"}
    assert found["E-1"].description == "first text" and found["E-1"].fault_count == 2
    assert found["E-1"].first_date == date(2024, 2, 1)


def test_monthly_trend_is_ordered(spark):
    trend = telemetry.monthly_trend(sample(spark)).collect()
    assert [row.month for row in trend] == ["2024-02", "2024-03", "2024-06", "2024-07"]
    assert trend[1].avg_energy == 10.0


def test_low_availability_rounds_before_it_compares(spark):
    rows = fact(
        spark,
        ("A", date(2024, 3, 1), 1.0, 89.996, None, None, "", None),
        ("B", date(2024, 3, 1), 1.0, 89.99, None, None, "E-1", None),
        ("C", date(2024, 3, 1), 1.0, 70.0, None, None, None, None),
        ("D", date(2024, 2, 29), 1.0, 10.0, None, None, None, None),
    )
    low = telemetry.low_availability_assets(rows)
    assert [(row.asset_id, row.fault_events_in_period) for row in low.collect()] == [("C", 0), ("B", 1)]
    assert telemetry.low_availability_count(low).first().low_availability_count == 2
    assert telemetry.low_availability_assets(rows, threshold=90.01).filter("asset_id = 'A'").first().fault_events_in_period == 1


def test_fault_history(spark):
    history = telemetry.fault_history(sample(spark), ["A"]).collect()
    assert [row.date for row in history] == [date(2024, 2, 1), date(2024, 3, 1)]
    assert telemetry.fault_history(sample(spark), ["Z"]).count() == 0
    assets = spark.createDataFrame([("A",), ("Z",)], "asset_id string")
    counts = {row.asset_id: row.fault_count for row in telemetry.fault_history_counts(sample(spark), assets).collect()}
    assert counts == {"A": 2, "Z": 0}


def test_one_busy_asset_is_folded_before_the_shuffle(spark):
    plan = telemetry.telemetry_summary(sample(spark), by=["asset_id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg(energy_kwh" in plan

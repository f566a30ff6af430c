from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import seasonal

FACT = "asset_id string, date date, energy_kwh double, availability_pct double, fault_code string, fault_description string"
DIMENSION = "asset_id string, type string, location string"


def readings(asset, before, after, avail=(99.0, 99.0), fault=None):
    return [
        (asset, date(2024, 1, 10), before, avail[0], None, None),
        (asset, date(2024, 4, 10), after, avail[1], fault, "later" if fault else None),
        (asset, date(2024, 3, 10), after, avail[1], fault, "first" if fault else None),
    ]


@pytest.fixture
def fleet(spark):
    def make(assets, facts):
        return (
            spark.createDataFrame([row for group in facts for row in group], FACT),
            spark.createDataFrame(assets, DIMENSION),
        )

    return make


def test_both_signals_flag_and_sort(spark, fleet):
    ids = [f"A{i}" for i in range(9)]
    facts = [readings(one, 100.0, 100.0 + i) for i, one in enumerate(ids)]
    facts[3] = readings("A3", 100.0, 20.0)
    facts[5] = readings("A5", 100.0, 104.0, (99.0, 94.0), "E-3002")
    telemetry, assets = fleet([(one, "wind", "Galicia") for one in ids], facts)
    found = seasonal.underperforming_assets(telemetry, assets).collect()
    assert [row.asset_id for row in found] == ["A5", "A3"]
    assert found[0].avail_drop_pct_pts == 5.0 and found[0].peer_count == 9
    assert found[1].z_score_ratio < -1.8 and found[1].seasonal_ratio == 0.2
    faults = seasonal.recent_faults(telemetry, seasonal.flagged(seasonal.seasonal_scores(telemetry, assets)))
    assert [tuple(row) for row in faults.collect()] == [("A5", "E-3002", "first")]
    listed = seasonal.with_recent_faults(seasonal.flagged(seasonal.seasonal_scores(telemetry, assets)), faults)
    assert {row.asset_id: len(row.recent_fault_codes) for row in listed.collect()} == {"A5": 1, "A3": 0}


def test_small_class_is_skipped_and_zero_deviation_scores_zero(spark, fleet):
    telemetry, assets = fleet(
        [("A", "wind", "x"), ("B", "wind", "x"), ("C", "solar", "x"), ("D", "solar", "x"), ("E", "solar", "x"), ("F", None, "x")],
        [readings(one, 100.0, 50.0) for one in "ABCDEF"],
    )
    scores = seasonal.seasonal_scores(telemetry, assets).collect()
    assert {row.asset_id for row in scores} == {"C", "D", "E"}
    assert {row.z_ratio for row in scores} == {0.0}
    unguarded = seasonal.seasonal_scores(telemetry, assets, guarded=False).collect()
    assert {row.asset_id for row in unguarded} == {"A", "B", "C", "D", "E"}
    assert {row.z_ratio for row in unguarded} == {None}


def test_incomplete_assets_leave_and_zero_before_has_no_ratio(spark, fleet):
    only_before = readings("P", 100.0, 50.0)[:1]
    telemetry, assets = fleet(
        [(one, "wind", "x") for one in "ABCPZ"],
        [readings(one, 100.0, 50.0) for one in "ABC"] + [only_before, readings("Z", 0.0, 5.0, (99.0, 90.0))],
    )
    scores = {row.asset_id: row for row in seasonal.seasonal_scores(telemetry, assets).collect()}
    assert set(scores) == {"A", "B", "C", "Z"}
    assert scores["Z"].seasonal_ratio is None and scores["Z"].z_ratio == 0.0
    assert [row.asset_id for row in seasonal.underperforming_assets(telemetry, assets).collect()] == ["Z"]


@pytest.mark.parametrize(
    ("location", "expected"),
    [(" spain ", {"A", "B", "C"}), ("Spa", {"A", "B", "C", "D", "E", "F"}), ("Atlantis", set())],
)
def test_location_is_exact_or_else_partial(spark, fleet, location, expected):
    assets = [(one, "wind", "Spain") for one in "ABC"] + [(one, "wind", "Northern Spain") for one in "DEF"]
    telemetry, dimension = fleet(assets, [readings(one, 100.0, 50.0) for one in "ABCDEF"])
    assert {row.asset_id for row in seasonal.seasonal_scores(telemetry, dimension, location).collect()} == expected


def test_exact_location_without_telemetry_does_not_count(spark, fleet):
    assets = [("A", "wind", "Spain")] + [(one, "wind", "Northern Spain") for one in "DEF"]
    telemetry, dimension = fleet(assets, [readings(one, 100.0, 50.0) for one in "DEF"])
    assert {row.asset_id for row in seasonal.seasonal_scores(telemetry, dimension, "Spain").collect()} == {"D", "E", "F"}


def test_year_and_comparison_month(spark, fleet):
    old = [(one, date(2023, 4, 1), 1.0, 1.0, None, None) for one in "ABC"]
    telemetry, assets = fleet(
        [(one, "wind", "x") for one in "ABC"], [readings(one, 100.0, 50.0, (99.0, 90.0)) for one in "ABC"] + [old]
    )
    scores = seasonal.seasonal_scores(telemetry, assets, year=2024).collect()
    assert {row.after_energy for row in scores} == {50.0}
    shown = seasonal.underperforming_assets(telemetry, assets, comparison_month="2024-05", year=2024).collect()
    assert len(shown) == 3 and {row.reporting_avg_kwh for row in shown} == {None}
    shown = seasonal.underperforming_assets(telemetry, assets, comparison_month="2023-04").collect()
    assert {row.reporting_avg_kwh for row in shown} == {1.0}


def test_facts_are_scanned_once(spark, tmp_path, fleet):
    telemetry, assets = fleet(
        [(f"A{i}", "wind", "x") for i in range(20)], [readings(f"A{i}", 100.0, 50.0 + i) for i in range(20)]
    )
    telemetry.write.parquet(str(tmp_path / "t"))
    assets.write.parquet(str(tmp_path / "a"))
    stored = seasonal.seasonal_scores(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "a")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored.collect()
        plan = stored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("availability_pct" in line for line in plan.splitlines() if "FileScan" in line) == 1


def test_series_of_the_worst(spark, fleet):
    telemetry, assets = fleet(
        [(f"A{i}", "wind", "x") for i in range(8)],
        [readings(f"A{i}", 100.0, 50.0, (99.0, 90.0 - i)) for i in range(8)],
    )
    series = seasonal.flagged_series(telemetry, seasonal.flagged(seasonal.seasonal_scores(telemetry, assets)), top=2)
    assert {row.asset_id for row in series.select("asset_id").collect()} == {"A6", "A7"}
    assert series.filter(F.col("month") == "2024-04").first().avg_energy == 50.0

"""Distinct assets and descriptions of any window, out of mergeable month rows."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import clean, distinct, value_cells
from fleetspark.operators.telemetry import select_rows
from fleetspark.sources.tables import write_profiled_telemetry, write_telemetry

FIRST = date(2023, 12, 20)
SCHEMA = "asset_id string, date date, x double, y double"


def readings(seed, size=3000, days=130):
    """Readings with nulls, repeats, zeros, negatives, extremes and one asset that has a third of them."""
    pick = random.Random(seed)
    rows = []
    for _ in range(size):
        asset = "HOT" if pick.random() < 1 / 3 else pick.choice([None, *[f"A{i}" for i in range(400)]])
        x = pick.choice([None, 0.0, pick.gauss(0, 1), pick.gauss(0, 1e6), 7.5, 1e-300, -1e300])
        rows.append((asset, FIRST + timedelta(days=pick.randrange(days)), x, pick.uniform(95, 99)))
    return rows


def test_numbers_are_dense(spark):
    ids = spark.createDataFrame([(f"A{i % 900}",) for i in range(3000)] + [(None,)], "asset_id string")
    found = {row.asset_id: row.number for row in distinct.dense_numbers(ids).collect()}
    assert sorted(found.values()) == list(range(1, 901)) and None not in found
    assert {row.asset_id: row.number for row in distinct.dense_numbers(ids.repartition(7)).collect()} == found


def test_assets_per_window(spark):
    rows = readings(1) + [("A1", None, 1.0, 1.0)]
    telemetry = spark.createDataFrame(rows, SCHEMA)
    places = {f"A{i}": f"P{i % 3}" for i in range(300)} | {"HOT": "P0"}
    assets = spark.createDataFrame(list(places.items()), "asset_id string, location string")
    bitmaps = distinct.asset_bitmaps(telemetry, distinct.dense_numbers(telemetry), assets)
    wanted = [(date(2023, 12, 1), date(2023, 12, 31)), (date(2024, 1, 1), date(2024, 3, 31)), (date(2030, 1, 1), date(2030, 1, 31))]
    windows = spark.createDataFrame(wanted + wanted[:1], "date_start date, date_end date")
    seen = [
        (start, end, places.get(asset), asset)
        for asset, day, *_ in rows
        for start, end in wanted
        if asset is not None and day is not None and start <= day <= end
    ]
    whole = {(s, e): len({a for s1, e1, _, a in seen if (s, e) == (s1, e1)}) for s, e, *_ in seen}
    found = distinct.assets_per_window(bitmaps, windows).collect()
    assert len(found) == len(whole) == 2
    assert {(r.date_start, r.date_end): r.asset_count for r in found} == whole
    by_place = {(s, e, p): len({a for *key, a in seen if key == [s, e, p]}) for s, e, p, _ in seen}
    found = distinct.assets_per_window(bitmaps, windows, ["location"]).collect()
    assert {(r.date_start, r.date_end, r.location): r.asset_count for r in found} == by_place


def test_more_assets_than_bits_of_a_row(spark):
    telemetry = spark.range(100_000).select(F.col("id").cast("string").alias("asset_id"), F.lit(FIRST).alias("date"))
    bitmaps = distinct.asset_bitmaps(telemetry, distinct.dense_numbers(telemetry))
    assert bitmaps.count() == 4
    assert distinct.distinct_assets(bitmaps).first().asset_count == 100_000


def test_no_assets(spark):
    none = spark.createDataFrame([(None, FIRST, 1.0, 1.0)], SCHEMA)
    bitmaps = distinct.asset_bitmaps(none, distinct.dense_numbers(none))
    assert distinct.distinct_assets(bitmaps).first().asset_count == 0
    windows = spark.createDataFrame([(FIRST, FIRST)], "date_start date, date_end date")
    assert distinct.assets_per_window(bitmaps, windows).count() == 0


WINDOWS = [
    ("2024-01-01", "2024-02-29"),
    ("2024-01-05", "2024-03-14"),
    ("2024-01-05", "2024-01-20"),
    ("2023-12-25", "2024-01-31"),
    ("2024-02-01", "2024-03-01"),
    ("2024-01-31", "2024-02-01"),
]


@pytest.mark.parametrize("window", WINDOWS)
def test_describe_window(spark, window):
    rows = readings(2)
    telemetry = spark.createDataFrame(rows, SCHEMA)
    cells = value_cells.value_cells(telemetry, ["x", "y"])
    found = {r.column: r for r in value_cells.describe_window(telemetry, cells, ["x", "y"], *window).collect()}
    first, last = map(date.fromisoformat, window)
    for at, name in ((2, "x"), (3, "y")):
        values = [row[at] for row in rows if first <= row[1] <= last and row[at] is not None]
        row = found[name]
        assert (row["count"], row["min"], row["max"]) == (len(values), min(values), max(values))
        assert [row.p25, row.p50, row.p75] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())
        if name == "y":
            assert (row["mean"], row["std"]) == pytest.approx((np.mean(values), np.std(values, ddof=1)))


def test_windows_without_values(spark):
    rows = [("A", date(2024, 1, 3), None, 5.0), ("A", date(2024, 2, 3), 1.0, None)]
    telemetry = spark.createDataFrame(rows, SCHEMA)
    cells = value_cells.value_cells(telemetry, ["x", "y"])
    january = value_cells.describe_window(telemetry, cells, ["x", "y"], "2024-01-01", "2024-01-31").collect()
    assert [(r.column, r["count"], r["std"], r.p50) for r in january] == [("y", 1, None, 5.0)]
    assert value_cells.describe_window(telemetry, cells, ["x", "y"], "2025-01-01", "2025-01-31").count() == 0


def test_cells_never_fall(spark):
    values = sorted(
        [0.0, 5e-324, 1e-300, 1.0, 1.7e308, float("inf"), *(s * 2.0**k for s in (-1, 1) for k in range(-60, 60)), -1.7e308]
    )
    df = spark.createDataFrame([(i, v) for i, v in enumerate([float("-inf"), *values, float("nan")])], "i int, v double")
    found = [row[0] for row in df.orderBy("i").select(value_cells._cell(F.col("v"))).collect()]
    assert found == sorted(found)


def test_describe_reads_the_months_of_the_window(spark, tmp_path):
    telemetry = spark.createDataFrame(readings(3), SCHEMA)
    write_telemetry(telemetry, f"{tmp_path}/facts")
    stored = spark.read.parquet(f"{tmp_path}/facts")
    cells = value_cells.value_cells(telemetry, ["x"])
    cells.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    found = value_cells.describe_window(stored, cells, ["x"], "2024-01-01", "2024-02-29")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "rows#" not in line]
    facts = [line for line in scans if "PartitionFilters: [isnotnull(month" in line]
    assert facts == scans
    assert facts and all("2024-01" in line and "2024-02" in line for line in facts)
    assert select_rows(stored, None, "2024-01-01", "2024-02-29").select("month").distinct().count() == 2


def test_observed_profile(spark, tmp_path):
    rows = [("A", FIRST, "F1"), ("B", FIRST, None), ("A", date(2024, 5, 1), ""), (None, date(2024, 1, 1), "F2")]
    telemetry = spark.createDataFrame(rows * 50, "asset_id string, date date, fault_code string")
    found = write_profiled_telemetry(telemetry, f"{tmp_path}/facts").collect()
    assert found == clean.telemetry_profile(telemetry).collect()
    assert spark.read.parquet(f"{tmp_path}/facts").count() == 200
    none = write_profiled_telemetry(telemetry.limit(0), f"{tmp_path}/none").collect()
    assert none == clean.telemetry_profile(telemetry.limit(0)).collect()

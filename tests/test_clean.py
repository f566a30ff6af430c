from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import clean
from fleetspark.sources import load_all, read_assets_csv
from fleetspark.sources.tables import ASSET_COLUMNS, write_telemetry
from fleetspark.operators.telemetry import select_rows

HEADER = ",".join(ASSET_COLUMNS)
GOOD = "\t wt-001 ,Turbine,wind_turbine,Galicia,1,2,4.8,Vestas,V150,2018-04-05,operational"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_asset_csv_is_cleaned(spark, tmp_path):
    path = write(
        tmp_path / "assets.csv",
        HEADER,
        GOOD,
        "PV-001,Plant,solar_plant,Murcia,1,2,n/a,LONGi,Hi-MO,bad,operational",
        "PV-002,Plant,tidal,Murcia,1,2,3,LONGi,Hi-MO,2025-01-01,operational",
    )
    found = {row.asset_id: row for row in read_assets_csv(spark, path).collect()}
    assert set(found) == {"WT-001", "PV-001", "PV-002"}
    assert found["WT-001"].install_date == date(2018, 4, 5)
    assert found["WT-001"].age_years == 5.74
    assert found["WT-001"].asset_class == "wind"
    assert found["PV-001"].install_date is None and found["PV-001"].age_years is None
    assert found["PV-001"].capacity_mw is None and found["PV-001"].asset_class == "solar"
    assert found["PV-002"].age_years == -1.0 and found["PV-002"].asset_class is None


def test_missing_column_and_duplicate_id_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="install_date"):
        read_assets_csv(spark, write(tmp_path / "a.csv", "asset_id,type", "WT-001,wind_turbine"))
    with pytest.raises(ValueError, match="WT-001"):
        read_assets_csv(spark, write(tmp_path / "b.csv", HEADER, GOOD, GOOD.replace("\t wt", "WT")))


def test_telemetry_drops_bad_dates_and_nan(spark, rows):
    raw = spark.createDataFrame(
        [
            (" wt-1 ", "2024-01-05", "10", "nan", "x", None, "1", "", None),
            ("WT-2", "bad", "1", "1", "1", "1", "1", None, None),
            ("WT-3", None, "1", "1", "1", "1", "1", None, None),
        ],
        "asset_id string, date string, energy_kwh string, availability_pct string, avg_wind_speed_ms string, "
        "irradiance_wm2 string, temperature_c string, fault_code string, fault_description string",
    )
    assert rows(clean.clean_telemetry(raw), "asset_id", "date", "energy_kwh", "availability_pct", "avg_wind_speed_ms") == [
        ("WT-1", date(2024, 1, 5), 10.0, None, None)
    ]


def test_casts(spark):
    texts = ["1", " 2.5 ", "1e3", "-.5", "inf", "1d", "1.5f", "0x1p3", "1_000", "nan", "", None]
    df = spark.createDataFrame([(text,) for text in texts], "x string")
    assert [row[0] for row in df.select(clean.as_number("x")).collect()] == [1, 2.5, 1000, -0.5, float("inf")] + [None] * 7
    texts = ["2024-01-05", "2024-1-5", " 2024-01-05 10:00:00", "2024-02-30", "epoch", "now", "05.01.2024", "", None]
    df = spark.createDataFrame([(text,) for text in texts], "x string")
    assert [row[0] for row in df.select(clean.as_date("x")).collect()] == [date(2024, 1, 5)] * 3 + [None] * 6
    typed = spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").alias("t"), F.lit(3).alias("n"), F.lit(1e20).alias("d"))
    row = typed.select(clean.as_date("t"), clean.as_number("n"), clean.as_number("d")).first()
    assert row.t is not None and (row.n, row.d) == (3.0, 1e20)


def test_maintenance_keeps_bad_dates(spark, rows):
    raw = spark.createDataFrame(
        [("1", "wt-1", "bad", "scheduled", None, None, None, "5")],
        "log_id string, asset_id string, date string, type string, description string, parts_replaced string, "
        "cost_eur string, duration_hours string",
    )
    cleaned = clean.clean_maintenance(raw)
    assert rows(cleaned, "asset_id", "date", "description", "parts_replaced", "cost_eur", "duration_hours") == [
        ("WT-1", None, "", "none", None, 5.0)
    ]


def test_label_and_status(spark):
    asset = spark.createDataFrame(
        [("WT-1", "T", "wind_turbine", "Galicia", "Vestas", "V", 4.8, date(2018, 4, 5), None, "operational")],
        "asset_id string, name string, type string, location string, manufacturer string, model string, "
        "capacity_mw double, install_date date, age_years double, status string",
    )
    assert clean.asset_label(asset).first().label == (
        "[WT-1 | T | wind turbine | Galicia | Vestas V | 4.8 MW | installed 2018-04-05 (? yrs) | operational]"
    )
    assert clean.result_status(asset, "x").first().status == "ok"
    assert clean.result_status(asset.filter("false"), "x").first().status == "no_data"


def test_metadata_becomes_scalar(spark):
    df = spark.createDataFrame([(None, 3, ["a"], None)], "a string, b int, c array<string>, d date")
    assert tuple(clean.scalar_metadata(df, df.columns).first()) == ("", 3, '["a"]', "")


def test_load_all_and_partitioned_telemetry(spark, tmp_path):
    write(tmp_path / "assets.csv", HEADER, GOOD)
    write(
        tmp_path / "telemetry.csv",
        "asset_id,date,energy_kwh,availability_pct,avg_wind_speed_ms,irradiance_wm2,temperature_c,fault_code,fault_description",
        "WT-001,2024-01-05,10,99,1,,3,,",
        "WT-001,2024-02-05,20,98,1,,3,E-1001,hot",
    )
    write(
        tmp_path / "maintenance_logs.csv",
        "log_id,asset_id,date,type,description,technician,duration_hours,parts_replaced,cost_eur",
        "M1,WT-001,2024-01-09,scheduled,service,Bo,4,,100",
    )
    write(tmp_path / "manual_excerpts.txt", "SECTION 1: X", "FAULT CODE: E-1001", "Name: " + "hot " * 30)
    tables = load_all(spark, str(tmp_path))
    assert {name: df.count() for name, df in tables.items()} == {"assets": 1, "telemetry": 2, "maintenance": 1, "manual": 1}
    assert tables["manual"].first().manufacturer == "Vestas"

    store = str(tmp_path / "store")
    write_telemetry(tables["telemetry"], store)
    stored = spark.read.parquet(store)
    january = select_rows(stored, None, "2024-01-01", "2024-01-31")
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert january.count() == 1
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date" in plan

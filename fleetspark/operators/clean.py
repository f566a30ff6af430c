"""Validation, cleaning and derived columns of the three tables."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise_key, rounded

# The date at which ages are taken, and the class of each asset type.
AGE_REFERENCE = "2024-01-01"
ASSET_CLASSES = {"wind_turbine": "wind", "solar_plant": "solar"}

TELEMETRY_NUMBERS = ("energy_kwh", "availability_pct", "avg_wind_speed_ms", "irradiance_wm2", "temperature_c")
MAINTENANCE_NUMBERS = ("cost_eur", "duration_hours")


def as_number(name: str) -> Column:
    """Text to double; unreadable text and NaN become null, since NaN compares as larger than any number.

    Spark also reads `1d`, `1.5f` and `0x1p3`, which are no numbers in a data file.
    """
    text = F.col(name).cast("string")
    plain = ~F.rlike(text, F.lit("(?i)[dfx]")) | F.rlike(text, F.lit(r"(?i)^\s*[+-]?inf(inity)?\s*$"))
    value = text.try_cast("double")
    return F.when(plain & ~F.isnan(value), value).alias(name)


def as_date(name: str) -> Column:
    """Text, date or timestamp to date; unreadable text becomes null, and so do words such as `epoch`."""
    text = F.col(name).cast("string")
    return F.when(F.rlike(text, F.lit(r"^\s*\d")), F.to_date(text.try_cast("timestamp_ntz"))).alias(name)


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise when a required column is absent. Looks at the schema only."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with the number of surplus rows."""
    return (
        df.groupBy(key)
        .agg((F.count(F.lit(1)) - 1).alias("surplus_rows"))
        .filter("surplus_rows > 0")
        .select(key, "surplus_rows")
    )


def require_unique(df: DataFrame, key: str, show: int = 20) -> None:
    """Raise when a key occurs twice; the message tells how many such keys there are and names the first few."""
    found = duplicate_keys(df, key).select(key, F.count(F.lit(1)).over(Window.partitionBy()).alias("total"))
    named = found.orderBy(key).limit(show).collect()
    if named:
        rest = named[0]["total"] - len(named)
        more = f" and {rest} more" if rest else ""
        raise ValueError(f"{named[0]['total']} duplicate {key}: {[row[0] for row in named]}{more}")


def clean_assets(raw: DataFrame, age_reference: str = AGE_REFERENCE) -> DataFrame:
    """Typed assets with `age_years` and `asset_class`. Rows with an unreadable install date are kept."""
    typed = raw.withColumns(
        {
            "asset_id": normalise_key(F.col("asset_id")),
            "install_date": as_date("install_date"),
            "capacity_mw": as_number("capacity_mw"),
        }
    )
    return typed.withColumns(
        {
            "age_years": age_years(F.col("install_date"), age_reference),
            "asset_class": asset_class(F.col("type")),
        }
    )


def age_years(install_date: Column, reference: str = AGE_REFERENCE) -> Column:
    """Age in years of 365.25 days, to two places; negative for a later install date."""
    return rounded(F.datediff(F.lit(reference).cast("date"), install_date) / F.lit(365.25), 2)


def asset_class(asset_type: Column, classes: dict[str, str] = ASSET_CLASSES) -> Column:
    """Class of an asset type; null for an unknown type."""
    mapped = None
    for name, label in classes.items():
        mapped = F.when(asset_type == name, label) if mapped is None else mapped.when(asset_type == name, label)
    return mapped


def clean_telemetry(raw: DataFrame) -> DataFrame:
    """Typed telemetry; rows without a readable date are dropped."""
    typed = raw.withColumns(
        {
            "asset_id": normalise_key(F.col("asset_id")),
            "date": as_date("date"),
            **{name: as_number(name) for name in TELEMETRY_NUMBERS},
        }
    )
    return typed.filter(F.col("date").isNotNull())


def clean_maintenance(raw: DataFrame) -> DataFrame:
    """Typed maintenance log; null descriptions become '' and null parts 'none', and null dates stay."""
    return raw.withColumns(
        {
            "asset_id": normalise_key(F.col("asset_id")),
            "date": as_date("date"),
            **{name: as_number(name) for name in MAINTENANCE_NUMBERS},
            "description": F.coalesce(F.col("description").cast("string"), F.lit("")),
            "parts_replaced": F.coalesce(F.col("parts_replaced").cast("string"), F.lit("none")),
        }
    )


def asset_label(df: DataFrame) -> DataFrame:
    """`asset_id` and a one-line label of each asset."""

    def shown(name: str, missing: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(missing))

    label = F.concat(
        F.lit("["),
        F.concat_ws(
            " | ",
            shown("asset_id"),
            shown("name"),
            F.translate(shown("type"), "_", " "),
            shown("location"),
            F.concat_ws(" ", shown("manufacturer"), shown("model")),
            F.concat(shown("capacity_mw", "?"), F.lit(" MW")),
            F.concat(
                F.lit("installed "), shown("install_date", "?"), F.lit(" ("), shown("age_years", "?"), F.lit(" yrs)")
            ),
            shown("status"),
        ),
        F.lit("]"),
    )
    return df.select("asset_id", label.alias("label"))


def lookup_assets(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the assets asked for, with the install date as text."""
    return assets.join(wanted.select("asset_id").distinct(), "asset_id", "left_semi").withColumn(
        "install_date", F.col("install_date").cast("string")
    )


def scalar_metadata(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Metadata columns as plain scalars: null becomes '', and what is not a scalar becomes text."""
    types = dict(df.dtypes)
    scalars = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    cleaned = {}
    for name in columns:
        if types[name] in scalars and types[name] != "string":
            cleaned[name] = F.col(name)
        elif types[name].startswith(("array", "map", "struct")):
            cleaned[name] = F.coalesce(F.to_json(name), F.lit(""))
        else:
            cleaned[name] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return df.withColumns(cleaned)


def telemetry_profile(telemetry: DataFrame) -> DataFrame:
    """Row count, distinct assets, date span and fault rows, in one row."""
    return telemetry.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("asset_id").alias("asset_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("fault_code").alias("fault_rows"),
    )


def maintenance_profile(maintenance: DataFrame) -> DataFrame:
    """Row count, distinct assets and rows of each kind, in one row."""
    return maintenance.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("asset_id").alias("asset_count"),
        F.count_if(F.col("type") == "scheduled").alias("scheduled_count"),
        F.count_if(F.col("type") == "corrective").alias("corrective_count"),
    )


def asset_profile(assets: DataFrame) -> DataFrame:
    """Assets of each class, and how many lack a readable install date or capacity."""
    return assets.groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.count_if(F.col("install_date").isNull()).alias("bad_install_dates"),
        F.count_if(F.col("capacity_mw").isNull()).alias("bad_capacities"),
    )


def result_status(result: DataFrame, label: str) -> DataFrame:
    """One row telling whether a result has rows: `ok`, or `no_data` with a message. It reads one row at most."""
    return result.limit(1).agg(F.count(F.lit(1)).alias("found")).select(
        F.when(F.col("found") == 0, "no_data").otherwise("ok").alias("status"),
        F.when(
            F.col("found") == 0,
            F.lit(f"no {label} rows match the filters; widen the dates or check the asset id"),
        ).alias("message"),
    )

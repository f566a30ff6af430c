"""Distinct assets of any window and place, counted from mergeable bitmaps.

Assets get dense numbers, and a month row holds the assets that it saw as bits, 32,768 to a row of 4 KB. Rows merge by OR, so any
months and places are counted exactly without going back to the readings, and a busy asset is one bit like any other.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .months import first_of_month

# Parts that ids are dealt into for numbering, and so the most rows that are summed and broadcast.
_SLOTS = 4096


def dense_numbers(ids: DataFrame, key: str = "asset_id") -> DataFrame:
    """A `number` from 1 without gaps for each distinct id; null ids have none.

    Ids are numbered within parts by hash, and a part begins where the parts before it end. The numbers depend on the ids alone.
    """
    known = ids.filter(F.col(key).isNotNull()).select(key).distinct()
    known = known.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(_SLOTS)))
    sizes = known.groupBy("_slot").agg(F.count(F.lit(1)).alias("_size"))
    sooner = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slot", F.coalesce(F.sum("_size").over(sooner), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(key))
    return known.join(F.broadcast(starts), "_slot").select(key, (F.col("_start") + place).alias("number"))


def asset_bitmaps(telemetry: DataFrame, numbers: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Bitmaps of the assets with readings per `month`, and per `location` where `assets` are given. Store it for many windows.

    Readings are folded to asset and month before any join. An asset that `assets` lack has a null location; rows without
    asset or date are left out.
    """
    seen = telemetry.select("asset_id", first_of_month("date").alias("month")).dropna().distinct()
    by = ["month"]
    if assets is not None:
        seen, by = seen.join(assets.select("asset_id", "location"), "asset_id", "left"), ["location", "month"]
    return (
        seen.join(numbers, "asset_id")
        .groupBy(*by, F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("assets"))
    )


def distinct_assets(bitmaps: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Distinct assets of each group, all its bitmaps merged."""
    by = list(by)
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("assets").alias("assets"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("assets")), F.lit(0)).alias("asset_count"))


def assets_per_window(bitmaps: DataFrame, windows: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Distinct assets of each window of whole months (`date_start`, `date_end`), and of each value of `by` in it.

    Equal windows are answered once. A window without assets has no row.
    """
    months = F.sequence(first_of_month("date_start"), first_of_month("date_end"), F.expr("interval 1 month"))
    wanted = windows.select("date_start", "date_end").distinct().withColumn("month", F.explode(months))
    return distinct_assets(wanted.join(bitmaps, "month"), ["date_start", "date_end", *by])

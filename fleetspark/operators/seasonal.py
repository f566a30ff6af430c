"""Assets that degrade more than the season explains.

One pass over the telemetry gives four conditional means per asset. The energy ratio after/before is compared with
the other assets of the class as a z-score, and the drop in availability with a fixed floor.
"""

import calendar
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text, rounded

# The two seasons and the thresholds.
BEFORE_MONTHS = (1, 2)
AFTER_MONTHS = (3, 4, 5, 6)
Z_THRESHOLD = -1.8
DROP_FLOOR = 4.0
MIN_PEERS = 3


def _months(day: str, months: tuple[int, ...]) -> Column:
    return F.month(day).isin(*months)


def _in_year(rows: DataFrame, year: int | None) -> DataFrame:
    return rows if year is None else rows.filter(F.col("date").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))


def month_bounds(label: str) -> tuple[date, date]:
    """First and last day of a `yyyy-MM` month."""
    year, month = (int(part) for part in label.split("-"))
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def seasonal_means(
    telemetry: DataFrame,
    before: tuple[int, ...] = BEFORE_MONTHS,
    after: tuple[int, ...] = AFTER_MONTHS,
) -> DataFrame:
    """Mean energy and availability of each asset before and after, in one aggregate.

    Each map task folds its rows into one partial row per asset, so a busy asset costs no more to shuffle than others.
    """

    def mean(name: str, months: tuple[int, ...]) -> Column:
        return F.avg(F.when(_months("date", months), F.col(name)))

    return telemetry.groupBy("asset_id").agg(
        mean("energy_kwh", before).alias("before_energy"),
        mean("energy_kwh", after).alias("after_energy"),
        mean("availability_pct", before).alias("before_availability"),
        mean("availability_pct", after).alias("after_availability"),
    )


def _z_score(value: str, mean: str, std: str, guarded: bool) -> Column:
    z = F.try_divide(F.col(value) - F.col(mean), F.col(std))
    return F.when(F.col(std).isNull() | (F.col(std) == 0), F.lit(0.0)).otherwise(z) if guarded else z


def _scope(location: str | None) -> Column:
    """Membership of an asset in a scope, null when it is outside: all assets, or a location its own equals or contains."""
    if location is None:
        return F.struct(F.lit(None).cast("string").alias("scope"), F.lit(True).alias("exact"))
    own, wanted = F.lower("location"), F.lit(location.strip().lower())
    member = F.struct(F.lit(location).alias("scope"), (clean_text(own) == wanted).alias("exact"))
    return F.when(F.contains(own, wanted), member)


def _scopes(locations: tuple[str | None, ...]) -> Column:
    """The scopes an asset belongs to, one row each when there are several to choose from."""
    if len(locations) == 1:
        return _scope(locations[0])
    return F.explode(F.array_compact(F.array(*[_scope(location) for location in locations])))


def assets_in_scope(assets: DataFrame, locations: tuple[str | None, ...]) -> DataFrame:
    """Assets with each `scope` of the locations that they belong to, and whether their own location equals it."""
    return (
        assets.withColumn("in_scope", _scopes(locations))
        .filter(F.col("in_scope").isNotNull())
        .select("*", "in_scope.scope", "in_scope.exact")
        .drop("in_scope")
    )


def location_status(telemetry: DataFrame, assets: DataFrame, location: str | None) -> DataFrame:
    """One row with `status` and `message`: `no_data` when no asset with telemetry is at the location."""
    seen = telemetry.select("asset_id").distinct()
    found = assets_in_scope(assets.join(seen, "asset_id", "left_semi"), (location,)).agg(F.count(F.lit(1)).alias("n"))
    place = f"no asset at location {location!r}" if location else "no asset"
    return found.select(
        F.when(F.col("n") > 0, "ok").otherwise("no_data").alias("status"),
        F.when(F.col("n") == 0, F.lit(place)).alias("message"),
    )


def scores_of_means(
    means: DataFrame,
    assets: DataFrame,
    locations: tuple[str | None, ...] = (None,),
    min_peers: int = MIN_PEERS,
    guarded: bool = True,
) -> DataFrame:
    """Signals and z-scores from the per-asset means, for each location asked for (`scope`, null for all assets).

    A location selects the assets whose location equals it, or, only when there is none, those whose location
    contains it. Peers are counted after that choice. `guarded=False` drops the peer minimum and the zero-deviation rule.

    The class figures come from a grouped aggregate that is joined back, and not from a window over the class: with two
    classes a window would sort half of all assets in one task. Both uses of the per-asset means need the same columns, so
    Spark shuffles them once and reuses the exchange; the fact table is scanned once.
    """
    dimension = assets.select("asset_id", F.col("type").alias("asset_class"), "location")
    scoped = (
        means.join(dimension, "asset_id")
        .filter(F.col("asset_class").isNotNull())
        .withColumn("avail_drop", F.col("before_availability") - F.col("after_availability"))
        .withColumn("seasonal_ratio", F.try_divide("after_energy", "before_energy"))
        .withColumn(
            "complete",
            F.col("before_energy").isNotNull() & F.col("after_energy").isNotNull() & F.col("avail_drop").isNotNull(),
        )
    )
    scoped = assets_in_scope(scoped, locations)

    def when_complete(name: str) -> Column:
        return F.when(F.col("complete"), F.col(name))

    # One row per scope, class and kind of match. The choice between exact and partial matches is made on these few rows;
    # the kind that loses finds no peers in the join below.
    peers = (
        scoped.groupBy("scope", "asset_class", "exact")
        .agg(
            F.count_if("complete").alias("peer_count"),
            F.avg(when_complete("seasonal_ratio")).alias("ratio_mean"),
            F.stddev_samp(when_complete("seasonal_ratio")).alias("ratio_std"),
            F.avg(when_complete("avail_drop")).alias("drop_mean"),
            F.stddev_samp(when_complete("avail_drop")).alias("drop_std"),
        )
        .withColumn("any_exact", F.max("exact").over(Window.partitionBy("scope")))
        .filter(F.col("exact") == F.col("any_exact"))
        .drop("any_exact")
    )
    if guarded:
        peers = peers.filter(F.col("peer_count") >= min_peers)
    # Two rows at most for each location asked for and class.
    left, right = scoped.filter("complete").alias("asset"), F.broadcast(peers).alias("peer")
    same_group = (
        F.col("asset.scope").eqNullSafe(F.col("peer.scope"))
        & (F.col("asset.asset_class") == F.col("peer.asset_class"))
        & (F.col("asset.exact") == F.col("peer.exact"))
    )
    return left.join(right, same_group).select(
        "asset.scope",
        "asset_id",
        "asset.asset_class",
        "location",
        "before_energy",
        "after_energy",
        "seasonal_ratio",
        "avail_drop",
        _z_score("seasonal_ratio", "ratio_mean", "ratio_std", guarded).alias("z_ratio"),
        _z_score("avail_drop", "drop_mean", "drop_std", guarded).alias("z_avail_drop"),
        "peer_count",
    )


def seasonal_scores(
    telemetry: DataFrame,
    assets: DataFrame,
    location: str | None = None,
    before: tuple[int, ...] = BEFORE_MONTHS,
    after: tuple[int, ...] = AFTER_MONTHS,
    year: int | None = None,
    min_peers: int = MIN_PEERS,
    guarded: bool = True,
) -> DataFrame:
    """Both signals and their z-scores for each asset that has both seasons, of all assets or of one location."""
    rows = _in_year(telemetry, year)
    if location is None:
        # Other months change no mean, so they go before the aggregate. With a location they still decide which assets
        # have telemetry at all, and with that whether a location matches exactly.
        rows = rows.filter(_months("date", tuple(before) + tuple(after)))
    return scores_of_means(seasonal_means(rows, before, after), assets, (location,), min_peers, guarded).drop("scope")


def flagged(scores: DataFrame, z_threshold: float = Z_THRESHOLD, drop_floor: float = DROP_FLOOR) -> DataFrame:
    """Assets whose energy ratio is a low outlier or whose availability fell by the floor or more (unrounded)."""
    low_ratio = F.coalesce(F.col("z_ratio") <= z_threshold, F.lit(False))
    return scores.filter(low_ratio | (F.col("avail_drop") >= drop_floor))


def _reporting_rows(
    telemetry: DataFrame, comparison_month: str | None, after: tuple[int, ...], year: int | None
) -> DataFrame:
    """Rows of the reporting window. A single month becomes a date range, which prunes files and row groups."""
    if comparison_month is None:
        return _in_year(telemetry, year).filter(_months("date", after))
    first, last = month_bounds(comparison_month)
    return telemetry.filter(F.col("date").between(F.lit(first), F.lit(last)))


def underperforming_assets(
    telemetry: DataFrame,
    assets: DataFrame,
    location: str | None = None,
    comparison_month: str | None = None,
    z_threshold: float = Z_THRESHOLD,
    drop_floor: float = DROP_FLOOR,
    before: tuple[int, ...] = BEFORE_MONTHS,
    after: tuple[int, ...] = AFTER_MONTHS,
    year: int | None = None,
    min_peers: int = MIN_PEERS,
) -> DataFrame:
    """The flagged assets with displayed figures, largest availability drop first.

    `comparison_month` changes the window of `reporting_avg_kwh` only; detection always compares the two seasons.
    """
    scores = seasonal_scores(telemetry, assets, location, before, after, year, min_peers)
    found = flagged(scores, z_threshold, drop_floor)
    if comparison_month is None:
        # The default window is the later season itself, whose mean is already there.
        with_window = found.withColumn("reporting_avg", F.col("after_energy"))
    else:
        window_mean = (
            _reporting_rows(telemetry, comparison_month, after, year)
            .groupBy("asset_id")
            .agg(F.avg("energy_kwh").alias("reporting_avg"))
        )
        with_window = found.join(window_mean, "asset_id", "left")
    return with_window.orderBy(F.desc("avail_drop"), "asset_id").select(
        *displayed_figures(),
        F.lit(comparison_month or "after season").alias("reporting_window"),
        rounded(F.col("reporting_avg"), 0).alias("reporting_avg_kwh"),
        "peer_count",
    )


def displayed_figures() -> list[Column]:
    """The figures of a flagged asset as they are shown."""
    return [
        F.col("asset_id"),
        F.col("asset_class"),
        rounded(F.col("z_ratio"), 2).alias("z_score_ratio"),
        rounded(F.col("z_avail_drop"), 2).alias("z_score_avail_drop"),
        rounded(F.col("before_energy"), 0).alias("jan_feb_avg_kwh"),
        rounded(F.col("after_energy"), 0).alias("post_march_avg_kwh"),
        rounded(F.col("seasonal_ratio"), 3).alias("seasonal_ratio"),
        rounded(F.col("avail_drop"), 2).alias("avail_drop_pct_pts"),
    ]


def recent_faults(
    telemetry: DataFrame,
    flagged_assets: DataFrame | None = None,
    comparison_month: str | None = None,
    after: tuple[int, ...] = AFTER_MONTHS,
    year: int | None = None,
) -> DataFrame:
    """Fault codes of the flagged assets in the reporting window, each with its first non-null description.

    Without `flagged_assets` those of all assets: for a caller that joins them to the flagged assets in any case.
    """
    rows = _reporting_rows(telemetry, comparison_month, after, year).filter(has_fault())
    described = F.when(F.col("fault_description").isNotNull(), F.struct("date", "fault_description"))
    codes = rows.groupBy("asset_id", "fault_code").agg(F.min(described)["fault_description"].alias("description"))
    return codes if flagged_assets is None else codes.join(flagged_assets.select("asset_id"), "asset_id", "left_semi")


def with_recent_faults(flagged_assets: DataFrame, faults: DataFrame) -> DataFrame:
    """Flagged assets with their fault codes as a list, empty when there are none.

    The list has one entry per distinct code of one asset, so its length is bounded by the fault catalogue.
    """
    lists = faults.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("fault_code", "description"))).alias("recent_fault_codes")
    )
    none = F.array().cast("array<struct<fault_code:string,description:string>>")
    return flagged_assets.join(lists, "asset_id", "left").withColumn(
        "recent_fault_codes", F.coalesce("recent_fault_codes", none)
    )


def has_fault() -> Column:
    """A fault code that is neither null nor empty."""
    return F.col("fault_code").isNotNull() & (F.col("fault_code") != "")


def location_asset_count(telemetry: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets with telemetry at each location."""
    seen = telemetry.select("asset_id").distinct()
    return (
        assets.join(seen, "asset_id", "left_semi")
        .groupBy("location")
        .agg(F.countDistinct("asset_id").alias("asset_count"))
    )


def late_fault_table(telemetry: DataFrame, flagged_assets: DataFrame, since: str) -> DataFrame:
    """Fault rows per asset, code and description from a date on, for flagged assets; null keys are dropped."""
    return (
        telemetry.filter((F.col("date") >= F.lit(since).cast("date")) & F.col("fault_code").isNotNull())
        .dropna(subset=["asset_id", "fault_description"])
        .groupBy("asset_id", "fault_code", "fault_description")
        .agg(F.count(F.lit(1)).alias("fault_rows"))
        .join(flagged_assets.select("asset_id"), "asset_id", "left_semi")
    )


def flagged_series(telemetry: DataFrame, flagged_assets: DataFrame, top: int = 5) -> DataFrame:
    """Mean energy per month of the `top` flagged assets by availability drop."""
    worst = flagged_assets.orderBy(F.desc("avail_drop"), "asset_id").limit(top).select("asset_id")
    return (
        telemetry.join(F.broadcast(worst), "asset_id", "left_semi")
        .groupBy("asset_id", F.date_format("date", "yyyy-MM").alias("month"))
        .agg(F.avg("energy_kwh").alias("avg_energy"))
    )

"""Exploratory profile of the tables."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import explode_rows, month_label

QUARTILES = (0.25, 0.5, 0.75)
# Relative rank error of the brackets that enclose a quantile.
_BRACKET_ACCURACY = 100_000


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of every column, in one row."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with their share of all rows. The total is a scalar over the grouped rows, not a second scan."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", F.col("rows") / total)


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Rows in each of `bins` equal-width bins from the minimum to the maximum; the maximum is in the last bin."""
    extremes = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    width = (F.col("high") - F.col("low")) / bins
    bin_no = F.when(F.col("high") == F.col("low"), F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col(column) - F.col("low")) / F.when(width != 0, width)), F.lit(bins - 1))
    )
    return (
        df.filter(F.col(column).isNotNull())
        .select(column, extremes.alias("extremes"))
        .select(column, "extremes.*")
        .groupBy((bin_no + 1).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _column_figures(df: DataFrame, columns: tuple[str, ...], lower: list[float], upper: list[float]) -> Column:
    """Struct of each column's moments, extremes and quantile brackets, as a scalar out of one scan."""
    figures = []
    for name in columns:
        value = F.col(name).cast("double")
        entry = F.struct(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.percentile_approx(value, lower + upper, _BRACKET_ACCURACY).alias("edges"),
        )
        figures.append(entry.alias(name))
    return df.agg(F.struct(*figures)).scalar()


# Cells that a bracket is cut into.
_CELLS = 256


def _ranked_quantiles(
    df: DataFrame, columns: tuple[str, ...], probabilities: tuple[float, ...], figures: Column
) -> DataFrame:
    """Exact quantiles given the brackets.

    One scan counts the values outside each bracket and finds the nearest of them, which is all that interpolation at the
    edge can need; another keeps the values inside. Counts per cell of the bracket, and a running count within each cell,
    yield the ranks, so no quantile is ranked in one task.
    """
    known = df.select(*[F.col(name).cast("double").alias(name) for name in columns], figures.alias("figures"))
    outside, inside, within = [], [], []
    for name in columns:
        value, own = F.col(name), F.col("figures")[name]
        for place, probability in enumerate(probabilities):
            low, high = own["edges"][place], own["edges"][place + len(probabilities)]
            tag = [F.lit(name).alias("column"), F.lit(probability).alias("probability")]
            below, above = value < low, value > high
            for side, beyond, nearest in ((-1, below, F.max), (1, above, F.min)):
                folded_value = nearest(F.when(beyond, value)).alias("value")
                outside.append(F.struct(*tag, F.lit(side).alias("side"), folded_value, F.count_if(beyond).alias("rows")))
            within.append(value.between(low, high))
            cell = F.coalesce(F.floor(F.try_divide(value - low, high - low) * _CELLS), F.lit(0)).cast("bigint")
            inside.append(F.when(within[-1], F.struct(*tag, cell.alias("cell"), value.alias("value"))))
    folded = known.agg(F.array(*outside).alias("sides")).select(F.explode("sides").alias("one")).select("one.*")
    hits = known.filter(reduce(Column.__or__, within))
    # A bracket is cut into cells. Their counts, a fixed number of rows, tell where each cell's ranks begin.
    per_value = (
        explode_rows(hits, [], F.array_compact(F.array(*inside)))
        .groupBy("item.column", "item.probability", "item.cell", "item.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    kept = per_value.withColumn("side", F.lit(0))
    cells = kept.groupBy("column", "probability", "side", "cell").agg(F.sum("rows").alias("rows")).unionByName(
        folded.select("column", "probability", "side", F.lit(0).cast("bigint").alias("cell"), "rows")
    )
    in_order = Window.partitionBy("column", "probability").orderBy("side", "cell")
    whole = Window.partitionBy("column", "probability")
    cells = cells.select(
        "column",
        "probability",
        "side",
        "cell",
        (F.sum("rows").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"),
        (F.col("probability") * (F.sum("rows").over(whole) - 1)).alias("target"),
    )
    # The value of the folded rows below is their largest, that of the rows above their smallest.
    order = Window.partitionBy("column", "probability", "side", "cell").orderBy("value")
    ranked = (
        folded.withColumn("cell", F.lit(0).cast("bigint"))
        .unionByName(kept)
        .join(F.broadcast(cells), ["column", "probability", "side", "cell"])
        .withColumn("upto", F.col("before") + F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    start = F.col("upto") - F.col("rows")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("upto")), F.col("value")))

    return (
        ranked.filter("target >= 0")
        .groupBy("column", "probability", "target")
        .agg(at(F.floor("target")).alias("left"), at(F.ceil("target")).alias("right"))
        .select(
            "column",
            "probability",
            (F.col("left") + (F.col("right") - F.col("left")) * (F.col("target") - F.floor("target"))).alias("value"),
        )
    )


def _brackets(probabilities: tuple[float, ...]) -> tuple[list[float], list[float]]:
    margin = 4.0 / _BRACKET_ACCURACY
    return [max(p - margin, 0.0) for p in probabilities], [min(p + margin, 1.0) for p in probabilities]


def exact_quantiles(df: DataFrame, columns: Iterable[str], probabilities: Iterable[float] = QUARTILES) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per column and probability, out of three scans.

    An exact percentile aggregate keeps every distinct value in one buffer. Here a first scan brackets each quantile with
    a sketch of known rank error, and the others rank the few values per hundred thousand inside each bracket.
    """
    columns, probabilities = tuple(columns), tuple(probabilities)
    figures = _column_figures(df, columns, *_brackets(probabilities))
    return _ranked_quantiles(df, columns, probabilities, figures)


def describe(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each column, one row per column.

    A column without values has no row.
    """
    columns = tuple(columns)
    return described(df, columns, _column_figures(df, columns, *_brackets(QUARTILES)))


def described(df: DataFrame, columns: tuple[str, ...], figures: Column) -> DataFrame:
    """The description of columns whose moments, extremes and quartile brackets are known."""
    quartiles = (
        _ranked_quantiles(df, columns, QUARTILES, figures)
        .groupBy("column")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in QUARTILES])
    )
    by_name = F.create_map(*[part for name in columns for part in (F.lit(name), F.col("figures")[name])])
    own = quartiles.withColumn("figures", figures).withColumn("own", by_name[F.col("column")])
    moments = [F.col(f"own.{name}").alias(name) for name in ("count", "mean", "std", "min", "max")]
    return own.select("column", *moments, *[f"p{round(p * 100)}" for p in QUARTILES])


def span(df: DataFrame) -> DataFrame:
    """Rows, columns, date span and distinct assets, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("asset_id").alias("asset_count"),
    )


def fault_rate(telemetry: DataFrame) -> DataFrame:
    """Rows with a non-null fault code, and their share."""
    return telemetry.agg(
        F.count("fault_code").alias("fault_rows"),
        F.avg(F.col("fault_code").isNotNull().cast("double")).alias("fault_rate"),
    )


def fleet_monthly(telemetry: DataFrame) -> DataFrame:
    """Mean energy and availability of the fleet per month."""
    return telemetry.groupBy(month_label(F.col("date")).alias("month")).agg(
        F.avg("energy_kwh").alias("avg_energy"), F.avg("availability_pct").alias("avg_avail")
    )


def top_faults(telemetry: DataFrame) -> DataFrame:
    """Rows per fault code, most frequent first."""
    return value_counts(telemetry.filter(F.col("fault_code").isNotNull()), "fault_code")


def monthly_cost(logs: DataFrame) -> DataFrame:
    """Maintenance cost per month."""
    return (
        logs.filter(F.col("date").isNotNull())
        .groupBy(month_label(F.col("date")).alias("month"))
        .agg(F.sum("cost_eur").alias("cost_eur"))
    )


def preview(df: DataFrame, order: Iterable[str], rows: int = 5) -> DataFrame:
    """First rows in a given order."""
    return df.orderBy(*order).limit(rows)

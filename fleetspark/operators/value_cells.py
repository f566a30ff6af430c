"""Value cells: how many values of a column lie in each of fixed narrow ranges, per month.

Cells of all months are the same, so they merge by addition, and their counts tell exactly which cells hold a quantile of any
window. Only the values inside these cells are then ranked.
"""

from calendar import monthrange
from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .months import first_of_month
from .profile import QUARTILES, described
from .telemetry import select_rows

# Cells between a value and its double, which bounds the rows of a month and column: 2,560 for values from 1 to 1,024.
_PER_OCTAVE = 256
# Beyond the exponents of all doubles, so that cells of positive values are positive.
_SMALLEST, _LARGEST = -1100 * _PER_OCTAVE, 1100 * _PER_OCTAVE


def _cell(value: Column) -> Column:
    """The number of the cell of a value, which never falls as the value grows; NaN is in the last."""
    octave = F.floor(F.log2(F.abs(value)) * _PER_OCTAVE)
    size = F.when(F.isnan(value), F.lit(_LARGEST)).otherwise(F.least(octave, F.lit(_LARGEST))) - _SMALLEST
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def value_cells(telemetry: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows, extremes, mean and squared deviations of each `month`, `column` and `cell` that has values. Store it for many windows.

    Nulls are in no cell, and rows without date in no month.
    """
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    values = telemetry.filter(F.col("date").isNotNull()).select(first_of_month("date").alias("month"), F.explode(items).alias("item"))
    values = values.select("month", "item.*").filter(F.col("value").isNotNull())
    return values.groupBy("month", "column", _cell(F.col("value")).alias("cell")).agg(
        F.count("value").alias("rows"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("deviations"),
    )


def _broken_months(first: date, last: date) -> list[tuple[date, date]]:
    """The parts of a window that are not whole months: none, one or two."""

    def month_end(day: date) -> date:
        return day.replace(day=monthrange(day.year, day.month)[1])

    parts = []
    if first.day > 1:
        parts.append((first, min(last, month_end(first))))
    if last < month_end(last) and (not parts or parts[0][1] < last):
        parts.append((max(first, last.replace(day=1)), last))
    return parts


def _window_figures(cells: DataFrame, columns: tuple[str, ...], probabilities: tuple[float, ...]) -> Column:
    """Struct of each column's moments, extremes and quantile brackets, as a scalar out of the cells."""
    totals = cells.groupBy("column").agg(
        F.sum("rows").alias("count"),
        (F.sum(F.col("rows") * F.col("mean")) / F.sum("rows")).alias("whole_mean"),
    )
    # One row per column.
    known = cells.join(F.broadcast(totals), "column")
    away = F.col("deviations") + F.col("rows") * (F.col("mean") - F.col("whole_mean")) ** 2
    merged = known.groupBy("column", "count", "whole_mean", "cell").agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(away).alias("away")
    )
    in_order = Window.partitionBy("column").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("rows").over(in_order))

    def at(edge: str, rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("upto") - F.col("rows")) & (rank < F.col("upto")), F.col(edge)))

    targets = [F.lit(p) * (F.col("count") - 1) for p in probabilities]
    edges = [at("low", F.floor(t)) for t in targets] + [at("high", F.ceil(t)) for t in targets]
    figures = ranked.groupBy("column", "count", "whole_mean").agg(
        F.sqrt(F.try_divide(F.sum("away"), F.col("count") - 1)).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.array(*edges).alias("edges"),
    )
    own = F.struct("count", F.col("whole_mean").alias("mean"), "std", "min", "max", "edges")
    return figures.agg(F.struct(*[F.max(F.when(F.col("column") == c, own)).alias(c) for c in columns])).scalar()


def describe_window(
    telemetry: DataFrame, cells: DataFrame, columns: Iterable[str], date_start: str, date_end: str
) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each column within a closed date range, one row per column.

    Whole months come from their cells and broken ones from their readings. The quartiles are then ranked among the readings of
    the window that lie in the cells found; readings stored by month are read for these months only. A column without values in
    the window has no row.
    """
    columns, first, last = tuple(columns), date.fromisoformat(date_start), date.fromisoformat(date_end)
    whole = cells.filter((F.col("month") >= F.lit(first)) & (F.last_day("month") <= F.lit(last)))
    broken = [
        value_cells(select_rows(telemetry, None, start.isoformat(), end.isoformat()), columns)
        for start, end in _broken_months(first, last)
    ]
    figures = _window_figures(reduce(DataFrame.unionByName, broken, whole), columns, QUARTILES)
    return described(select_rows(telemetry, None, date_start, date_end), columns, figures)

"""Array helpers."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, also where `use` reads it in a lambda or in many branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_rows(df: DataFrame, kept: Iterable[str], items: Column, name: str = "item") -> DataFrame:
    """The kept columns and one row per item of an array column; rows without items have none.

    A plain explode makes Spark test `size(items) > 0` in a filter below it, which evaluates the array a second time.
    Exploding with nulls and dropping them afterwards computes it once, which counts when it comes from a regex over text.
    """
    return df.select(*kept, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())

"""Numeric column helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles are summed in whatever order partitions arrive, so a value that is exactly half-way in decimal
# may land one ulp on either side. The nudge puts all such values on the same side, which keeps a rounded
# result independent of the partitioning.
_TIE_NUDGE = 1e-9


def rounded(value: Column, digits: int) -> Column:
    """Round half up to `digits` places, with the same result for any summation order."""
    return F.round(value + F.lit(_TIE_NUDGE), digits)


def clamp01(value: Column, digits: int = 3) -> Column:
    """Round a score into [0, 1]."""
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), digits)

"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division as in floating point: 0/0 is NaN, anything else over 0 an infinity. Spark's own raises or gives null."""
    top, bottom = top.cast("double"), bottom.cast("double")
    inf = F.lit(float("inf"))
    return F.when(bottom == 0, F.when((top == 0) | F.isnan(top), F.lit(float("nan"))).when(top > 0, inf).otherwise(-inf)).otherwise(top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom))


def single(value: Column) -> Column:
    """Rounded to 32 bits, as weights are stored."""
    return value.cast("float")

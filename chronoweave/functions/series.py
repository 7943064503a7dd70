"""Trends and regular series of interval values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interval import END, START
from .resolution import Resolution


def slope(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The least-squares slope of y over x for each key, rounded to six places; null for a single point."""
    return points.groupBy(*keys).agg(F.round(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), 6).alias("slope"))


def expanded(values: DataFrame, keys: Sequence[str], resolution: Resolution) -> DataFrame:
    """(keys, i, value): interval values as points, numbered in the resolution from the key's first start.

    An interval's last number is that of its end, inclusive; where two meet, the later start wins.
    """
    first = values.groupBy(*keys).agg(resolution.anchor(F.min(START)).alias("__a"))
    at = values.join(first, list(keys))
    numbers = F.sequence(resolution.index(F.col(START), F.col("__a")), resolution.index(F.col(END), F.col("__a")))
    each = at.withColumn("i", F.explode(numbers))
    return each.groupBy(*keys, "i").agg(F.max_by("value", F.struct(START, END)).alias("value"))


def linear_trend(values: DataFrame, keys: Sequence[str], resolution: Resolution) -> DataFrame:
    """The slope of interval values (keys, t_start, t_end, value) over their numbered points."""
    return slope(expanded(values, keys, resolution), keys, "i", "value")


def make_series(values: DataFrame, keys: Sequence[str], resolution: Resolution, fill: Column | None = None) -> DataFrame:
    """(keys, i, value) without holes: numbers between the first and the last that no interval covers get the fill value."""
    points = expanded(values, keys, resolution)
    frame = points.groupBy(*keys).agg(F.max("i").alias("__n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("__n")))).drop("__n")
    out = frame.join(points, [*keys, "i"], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", fill))

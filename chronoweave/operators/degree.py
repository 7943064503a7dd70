"""Degrees over time and their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, running_total


def degree(g: TemporalGraph) -> DataFrame:
    """(vid, t_start, t_end, degree): incident edge ends, parallel edges and both ends of loops counted; zero is left out."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("vid"), START, END)
    out = running_total(ends, V_KEY, F.lit(1).cast("long"), "degree")
    return out.select("vid", START, END, F.col("degree").cast("int").alias("degree"))


def degree_distribution(g: TemporalGraph) -> DataFrame:
    """(degree, n): how many (vertex, period) pairs have each degree."""
    return degree(g).groupBy("degree").agg(F.count("*").alias("n"))

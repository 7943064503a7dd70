"""Triangles and clustering coefficients over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, attached, islands, overlap_join, running_total, swept
from chronoweave.plans.storage import written

from .degree import degree


def _triangles(g: TemporalGraph) -> DataFrame:
    """(vid, t_start, t_end, triangles). Arcs lead from the end with fewer neighbours over all time to the other, so
    that no hub makes a square of pairs; three arcs make a triangle while all of them hold."""
    e = g.edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), START, END)
    pairs = written(islands(e, ["a", "b"]), "pairs")
    n = pairs.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    ranked = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    low = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    ends = [F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")]
    arcs = written(ranked.select(*ends, START, END), "arcs")
    two = arcs.select(F.col("x").alias("__x"), F.col("y").alias("z"), F.col(START).alias("__s"), F.col(END).alias("__e"))
    wedges = overlap_join(arcs, two, (F.col("x") == F.col("__x")) & (F.col("y") < F.col("z")), ("__s", "__e"))
    third = pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col(START).alias("__s"), F.col(END).alias("__e"))
    found = overlap_join(wedges, third, (F.col("y") == F.col("__a")) & (F.col("z") == F.col("__b")), ("__s", "__e"))
    corners = found.select(F.explode(F.array("x", "y", "z")).alias("vid"), START, END)
    return running_total(corners, V_KEY, F.lit(1).cast("long"), "triangles").select("vid", START, END, "triangles")


def triangle_count(g: TemporalGraph) -> DataFrame:
    """Vertices with triangles: how many different triangles pass through them; loops and parallel edges do not matter."""
    return attached(g.vertices, _triangles(g), {"triangles": F.coalesce("triangles", F.lit(0)).cast("int")})


def clustering_coefficient(g: TemporalGraph) -> DataFrame:
    """Vertices with ccoeff: triangles / (k * (k - 1)), k the degree with parallel edges counted; 0 without a triangle."""
    both = swept(_triangles(g), degree(g), V_KEY, ["triangles"], ["degree"]).where("a is not null")
    k = F.col("b.degree").cast("long")
    rates = both.select("vid", START, END, (F.col("a.triangles") / (k * (k - 1))).alias("c"))
    return attached(g.vertices, rates, {"ccoeff": F.coalesce("c", F.lit(0.0))})

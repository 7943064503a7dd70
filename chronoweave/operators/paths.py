"""Shortest paths to landmarks over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, attached, both_ways, islands, overlap_join, swept, temporal_aggregate
from chronoweave.plans.storage import Growing, written


def shortest_paths(g: TemporalGraph, landmarks: Sequence[int], directed: bool = True) -> DataFrame:
    """Vertices with distances, a map from landmark to the hops needed to reach it along edges; unreachable ones are not in it.

    Breadth first: a round steps back from the last frontier and takes away the periods in which a vertex has been reached.
    """
    key = ["vid", "landmark"]
    e = (g.edges.select("src", "dst", START, END) if directed else both_ways(g.edges)).where("src != dst")
    back = written(islands(e, ["src", "dst"]).select(F.col("dst").alias("__v"), F.col("src").alias("to"), F.col(START).alias("__s"), F.col(END).alias("__e")), "back")
    reached = Growing(g.vertices.sparkSession, "reached")
    frontier = islands(g.vertices.where(F.col("vid").isin(*landmarks)), V_KEY).withColumns({"landmark": F.col("vid"), "d": F.lit(0)})
    frontier = reached.add(frontier.select(*key, START, END, "d"))
    while not frontier.isEmpty():
        step = overlap_join(frontier, back, F.col("vid") == F.col("__v"), ("__s", "__e"))
        step = islands(step.select(F.col("to").alias("vid"), "landmark", START, END), key)
        new = swept(step, reached.all(), key).where("a is not null and b is null")
        frontier = reached.add(islands(new, key).select(*key, START, END, F.lit(reached.rounds).alias("d")))
    near = temporal_aggregate(reached.all(), V_KEY, [F.sort_array(F.collect_list(F.struct("landmark", "d"))).alias("near")])  # one entry a landmark at most
    none = F.array().cast("array<struct<landmark:bigint,d:int>>")
    out = attached(g.vertices, near, {"near": F.coalesce("near", none)})
    return out.select("vid", START, END, "attr", F.map_from_entries("near").alias("distances"))

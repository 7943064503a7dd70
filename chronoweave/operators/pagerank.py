"""PageRank over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, attached, both_ways, islands, overlap_join, running_total, summed
from chronoweave.plans.storage import Growing, written


def pagerank(g: TemporalGraph, tol: float, reset: float = 0.15, iterations: int = 2**31 - 1, directed: bool = True) -> DataFrame:
    """Vertices with rank, unnormalised: reset plus what flows in. A vertex passes on a change above tol only.

    Changes are intervals, cut only where a vertex gets something else. A round joins the last changes with the
    weighted edges and sums by receiver in a sweep; the rounds' changes are one table, summed once at the end.
    g's relations are read several times: a graph that is costly to compute should be stored before.
    """
    e = g.edges.select("src", "dst", START, END) if directed else both_ways(g.edges)
    out = running_total(e.withColumnRenamed("src", "__v"), ["__v"], F.lit(1), "__n").withColumnsRenamed({START: "__s", END: "__e"})
    weighted = overlap_join(e, out, F.col("src") == F.col("__v"), ("__s", "__e"))
    weighted = written(weighted.select("src", "dst", START, END, (F.lit(1 - reset) / F.col("__n")).alias("w")), "weights")
    changes = Growing(g.vertices.sparkSession, "changes")
    change = changes.add(islands(g.vertices, V_KEY).withColumn("d", F.lit(float(reset))))
    for _ in range(iterations):
        last = change.where(F.col("d") > tol).select(F.col("vid").alias("__v"), F.col("d").alias("__d"), F.col(START).alias("__s"), F.col(END).alias("__e"))
        sent = overlap_join(weighted, last, F.col("src") == F.col("__v"), ("__s", "__e"))
        got = summed(sent.select(F.col("dst").alias("vid"), START, END, (F.col("__d") * F.col("w")).alias("d")), V_KEY, "d")
        change = changes.add(got.select("vid", START, END, "d"))
        if change.isEmpty():
            break
    ranks = summed(changes.all(), V_KEY, "d").withColumnRenamed("d", "rank")
    return attached(g.vertices, ranks, {"rank": F.col("rank")})

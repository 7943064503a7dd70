"""Connected components over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, attached, islands, overlap_join, swept, temporal_aggregate
from chronoweave.plans.storage import written


def _follow(labels: DataFrame, up: DataFrame) -> DataFrame:
    """(x, p) with p replaced by what up says of it at the time; where up says nothing, nothing is left."""
    to = up.select(F.col("x").alias("__x"), F.col("p").alias("__p"), F.col(START).alias("__s"), F.col(END).alias("__e"))
    out = overlap_join(labels, to, F.col("p") == F.col("__x"), ("__s", "__e"))
    return out.select("x", F.col("__p").alias("p"), START, END)


def _hooked(edges: DataFrame) -> DataFrame:
    """(x, p): every end's least neighbour or itself, followed three times."""
    ends = edges.select(F.col("a").alias("x"), "b", START, END).unionAll(edges.select("b", "a", START, END))
    hook = temporal_aggregate(ends, ["x"], [F.min("b").alias("p")]).withColumn("p", F.least("x", "p"))
    hook = written(islands(hook, ["x", "p"]), "hooks")
    out = hook
    for _ in range(3):
        out = _follow(out, hook)
    return written(islands(out, ["x", "p"]), "jumps")


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return written(islands(edges.where(f"{a} != {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), START, END), ["a", "b"]), "edges")


def connected_components(g: TemporalGraph) -> DataFrame:
    """Vertices with component, the least vertex id that is reachable, directions aside.

    Each round hooks and contracts: edges within a found component vanish, so rounds grow with the logarithm of a
    component's size, not with its diameter. Edges, roots and labels are intervals, cut only where a root changes.
    """
    edges = _pairs(g.edges, "src", "dst")
    roots = islands(g.vertices, V_KEY).select(F.col("vid").alias("x"), START, END)
    labels = None
    while not edges.isEmpty():
        jumps = _hooked(edges)
        all_ = swept(roots, jumps, ["x"], [], ["p"]).select("x", F.coalesce("b.p", "x").alias("p"), START, END)
        all_ = written(islands(all_, ["x", "p"]), "roots")
        roots = all_.where("x = p").drop("p")
        labels = all_ if labels is None else written(islands(_follow(labels, all_), ["x", "p"]), "labels")
        for end in "ab":
            to = jumps.select(F.col("x").alias("__x"), F.col("p").alias(f"p{end}"), F.col(START).alias("__s"), F.col(END).alias("__e"))
            edges = overlap_join(edges, to, F.col(end) == F.col("__x"), ("__s", "__e")).drop("__x")
        edges = _pairs(edges, "pa", "pb")
    if labels is None:
        return g.vertices.withColumn("component", F.col("vid"))
    return attached(g.vertices, labels.withColumnRenamed("x", "vid"), {"component": F.coalesce("p", "vid")})

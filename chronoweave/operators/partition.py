"""Partition strategies for snapshot edges (src, dst, t), as repartition expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import START
from chronoweave.plans.graph import E_COLUMNS, TemporalGraph

STRATEGIES = ("canonical_random_vertex_cut", "edge_partition_2d", "naive_temporal", "consecutive_temporal", "hybrid_random_temporal", "hybrid_2d_temporal")


#: A prime; products of numbers under it and the factors here stay under 2**63, so that any engine's integers do.
PRIME = (1 << 31) - 1


def _hash(c: Column) -> Column:
    return F.pmod(F.pmod(c, F.lit(PRIME)) * 48271 + 11, F.lit(PRIME))


def _random_cut(n: Column) -> Column:
    """The same part for both directions of an edge."""
    return F.pmod(F.pmod(_hash(F.least("src", "dst")) * 31 + _hash(F.greatest("src", "dst")), F.lit(PRIME)), n)


def _two_d(n: Column) -> Column:
    """A cell of a square grid: a vertex is in one row and one column only."""
    side = F.ceil(F.sqrt(n)).cast("long")
    return F.pmod(F.pmod(_hash(F.col("dst")), side) * side + F.pmod(_hash(F.col("src")), side), n)


def _spread(i: Column, groups: int, n: int, within: Callable[[Column], Column]) -> Column:
    """More parts than groups: each group has parts of its own, the first ones one more where it does not come out even."""
    each, more = divmod(n, groups)
    size = F.when(i < more, F.lit(each + 1)).otherwise(F.lit(each)).cast("long")
    return i * each + F.least(i, F.lit(more)) + within(size)


def _runs(i: Column, groups: int, n: int) -> Column:
    """More groups than parts: each part has consecutive ones, the first parts one more where it does not come out even."""
    each, more = divmod(groups, n)
    longer = more * (each + 1)
    return F.when(i < longer, F.floor(i / (each + 1))).otherwise(more + F.floor((i - longer) / max(1, each)))


def part_of(strategy: str, n: int, intervals: int, runs: int = 1) -> Column:
    """The part, 0 to n - 1, of each row; runs is how many consecutive intervals a hybrid strategy keeps together."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    width = runs if strategy.startswith("hybrid") else 1
    i, groups = F.floor(F.col("t") / width), max(1, math.ceil(intervals / width))
    within = _two_d if strategy in ("edge_partition_2d", "hybrid_2d_temporal") else _random_cut
    if "temporal" not in strategy:
        part = within(F.lit(n).cast("long"))
    elif groups < n:
        part = _spread(i, groups, n, within)
    else:
        part = F.pmod(i, F.lit(n)) if strategy == "naive_temporal" else _runs(i, groups, n)
    return part.cast("int")


def partition_by(edges: DataFrame, strategy: str, n: int, intervals: int, runs: int = 1) -> DataFrame:
    """edges with their part, dealt so that rows of a part are in one partition."""
    return edges.withColumn("part", part_of(strategy, n, intervals, runs)).repartition(n, "part")


def partition_graph(g: TemporalGraph, strategy: str, n: int, runs: int = 1) -> TemporalGraph:
    """The graph with its edge tuples dealt by a strategy, temporal ones by the snapshot in which a tuple starts; vertices by id."""
    sequence = g.sequence().select("idx", F.col(START).alias("__s")).persist()
    starts = F.broadcast(sequence)  # a row for each day at most
    numbered = g.edges.join(starts, F.col(START) == F.col("__s")).withColumn("t", F.col("idx"))
    e = partition_by(numbered, strategy, n, sequence.count(), runs).select(*E_COLUMNS)
    return replace(g, vertex_tuples=g.vertices.repartition(n, "vid"), edge_tuples=e, v_coalesced=True, e_coalesced=True)


def estimate_partitions(megabytes: float) -> int:
    """How many partitions to read an input into, by its size."""
    if megabytes < 8:
        return 2
    if megabytes <= 150:
        return 16
    return round(0.155 * megabytes + 70) if megabytes <= 1000 else round(0.0488 * megabytes + 150)

"""Temporal zoom (by calendar windows or by changes) and structural zoom (by attributes)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.functions.quantify import Quantifier
from chronoweave.functions.reducers import MERGES, Reducer, reducer
from chronoweave.functions.resolution import Resolution
from chronoweave.plans.graph import E_COLUMNS, TemporalGraph
from chronoweave.plans.normalize import E_KEY, V_KEY, merged_aggregate, overlap_join, temporal_aggregate


@dataclass(frozen=True)
class ChangeSpec:
    """Windows of n consecutive elementary intervals of the graph; the last may be shorter."""

    n: int


@dataclass(frozen=True)
class TimeSpec:
    """Calendar windows, numbered from the one in which the graph starts."""

    resolution: Resolution


def _reduce(windowed: DataFrame, keys: Sequence[str], quantifier: Quantifier, r: Reducer) -> DataFrame:
    """(keys, w_start, w_end, attr, t_start, t_end) by window: covered days against the window's, attributes by start."""
    covered = F.datediff(F.least(F.col(END), F.col("w_end")), F.greatest(F.col(START), F.col("w_start")))
    out = windowed.groupBy(*keys, "w_start", "w_end").agg(F.sum(covered).alias("__c"), r(F.col("attr"), F.col(START)).alias("attr"))
    out = out.where(quantifier(F.col("__c"), F.datediff("w_end", "w_start")))
    return out.select(*keys, F.col("w_start").alias(START), F.col("w_end").alias(END), "attr")


def _by_time(df: DataFrame, resolution: Resolution, span: DataFrame) -> DataFrame:
    """Rows of df for each window they meet. The span is one row, joined by broadcast, so no job runs early."""
    anchored = df.join(F.broadcast(span.select(resolution.anchor(F.col(START)).alias("__a")).where("__a is not null")))
    each = anchored.withColumn("__w", F.explode(resolution.windows_of(F.col(START), F.col(END), F.col("__a"))))
    return each.withColumns({"w_start": resolution.start(F.col("__w"), F.col("__a")), "w_end": resolution.start(F.col("__w") + 1, F.col("__a"))})


def _by_change(df: DataFrame, n: int, sequence: DataFrame) -> DataFrame:
    """Every start and end of a tuple is a boundary of the sequence: equi joins give its window numbers.

    The sequence has a row for each day at most, so it is always small.
    """
    starts = F.broadcast(sequence.select(F.col(START).alias("__sd"), F.floor(F.col("idx") / n).alias("__w1")))
    ends = F.broadcast(sequence.select(F.col(END).alias("__ed"), F.floor(F.col("idx") / n).alias("__w2")))
    windows = F.broadcast(sequence.groupBy(F.floor(F.col("idx") / n).alias("__w")).agg(F.min(START).alias("w_start"), F.max(END).alias("w_end")))
    each = df.join(starts, F.col(START) == F.col("__sd")).join(ends, F.col(END) == F.col("__ed"))
    return each.withColumn("__w", F.explode(F.sequence("__w1", "__w2"))).join(windows, "__w")


def temporal_zoom(g: TemporalGraph, spec: TimeSpec | ChangeSpec, vquant: Quantifier, equant: Quantifier, vreduce: str | Reducer, ereduce: str | Reducer) -> TemporalGraph:
    """Tuples become whole windows if they cover enough of them; edges are kept within the new vertices."""
    if isinstance(spec, TimeSpec):
        span = g.span()
        windowed = lambda df: _by_time(df, spec.resolution, span)
    elif isinstance(spec, ChangeSpec):
        seq = g.sequence()
        windowed = lambda df: _by_change(df, spec.n, seq)
    else:
        raise ValueError(f"not a window specification: {spec!r}")
    v = _reduce(windowed(g.vertices), V_KEY, vquant, reducer(vreduce))
    e = _reduce(windowed(g.edges), E_KEY, equant, reducer(ereduce))
    out = replace(g, vertex_tuples=v, edge_tuples=e, v_coalesced=False, e_coalesced=False)
    return out if vquant == equant else out.constrained()  # equal quantifiers: an edge's ends cover what it covers


def structural_zoom(g: TemporalGraph, group: Callable[[Column, Column], Column], vreduce: str | Reducer) -> TemporalGraph:
    """Vertices become groups group(vid, attr); edges keep their ids and lead between the groups of their ends.

    Members are aligned within their group only, not on the whole graph's sequence; where the reducer merges, those
    of equal interval are reduced before they are cut, so a group of a third of all vertices is no hot key.
    """
    members = g.vertices.withColumn("__g", group(F.col("vid"), F.col("attr")))
    grouped = members.select(F.col("__g").alias("vid"), START, END, "attr")
    if vreduce in MERGES:
        v = merged_aggregate(grouped, V_KEY, reducer(vreduce)(F.col("attr"), F.col(START)), reducer(MERGES[vreduce])(F.col("attr"), F.col(START)))
    else:
        v = temporal_aggregate(grouped, V_KEY, [reducer(vreduce)(F.col("attr"), F.col(START)).alias("attr")])
    e = g.edges
    for end in ("src", "dst"):
        m = members.select(F.col("vid").alias("__v"), F.col("__g").alias(f"__{end}"), F.col(START).alias("__s"), F.col(END).alias("__e"))
        e = overlap_join(e, m, F.col(end) == F.col("__v"), ("__s", "__e")).drop("__v")
    e = e.withColumns({"src": F.col("__src"), "dst": F.col("__dst")}).select(*E_COLUMNS)
    return replace(g, vertex_tuples=v, edge_tuples=e, v_coalesced=False, e_coalesced=False)

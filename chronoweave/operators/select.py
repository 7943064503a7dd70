"""Slices, subgraphs and maps. Predicates and functions take and return columns, so that Catalyst sees them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START, date, overlaps
from chronoweave.plans.graph import E_COLUMNS, TemporalGraph
from chronoweave.plans.normalize import constrain_edges


def select(relation: DataFrame, keep: Column) -> DataFrame:
    """Tuples of a temporal relation that pass."""
    return relation.where(keep)


def clip(relation: DataFrame, s: Column, e: Column) -> DataFrame:
    """What of a relation lies in [s, e)."""
    inside = relation.where(overlaps(F.col(START), F.col(END), s, e))
    return inside.withColumns({START: F.greatest(F.col(START), s), END: F.least(F.col(END), e)})


def slice(g: TemporalGraph, start: str | datetime.date, end: str | datetime.date) -> TemporalGraph:  # noqa: A001
    """The graph within [start, end). Coalesced relations stay so."""
    s, e = date(start), date(end)
    return replace(g, vertex_tuples=clip(g.vertex_tuples, s, e), edge_tuples=clip(g.edge_tuples, s, e))


def vsubgraph(g: TemporalGraph, keep: Callable[[Column, Column, Column, Column], Column]) -> TemporalGraph:
    """Vertices that pass keep(vid, attr, t_start, t_end), and their edges while both ends pass."""
    v = g.vertices.where(keep(F.col("vid"), F.col("attr"), F.col(START), F.col(END)))
    return replace(g, vertex_tuples=v, v_coalesced=True, edge_tuples=constrain_edges(v, g.edge_tuples), e_coalesced=False)


def esubgraph(g: TemporalGraph, keep: Callable[[dict[str, Column]], Column], endpoints: bool = False) -> TemporalGraph:
    """All vertices, and the edges that pass keep(columns).

    With endpoints, src_attr and dst_attr are there too, and edges are cut where these change.
    """
    rows = g.triplets() if endpoints else g.edges
    return replace(g, edge_tuples=rows.where(keep({c: F.col(c) for c in rows.columns})).select(*E_COLUMNS), e_coalesced=not endpoints)


def vmap(g: TemporalGraph, f: Callable[[Column, Column, Column, Column], Column]) -> TemporalGraph:
    """New vertex attributes f(vid, attr, t_start, t_end) of coalesced tuples."""
    v = g.vertices.withColumn("attr", f(F.col("vid"), F.col("attr"), F.col(START), F.col(END)))
    return replace(g, vertex_tuples=v, v_coalesced=False)


def emap(g: TemporalGraph, f: Callable[[dict[str, Column]], Column]) -> TemporalGraph:
    """New edge attributes f(columns) of coalesced tuples."""
    e = g.edges
    return replace(g, edge_tuples=e.withColumn("attr", f({c: F.col(c) for c in e.columns})), e_coalesced=False)

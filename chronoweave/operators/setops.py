"""Sequenced union, difference and intersection. Relations are aligned per key, never on a global sequence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START, overlaps
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import E_KEY, V_KEY, align, merge_interval_lists, swept

Combine = Callable[[Column, Column], Column]


def _union(a: DataFrame, b: DataFrame, keys: list[str], f: Combine) -> DataFrame:
    return merge_interval_lists(a, b, keys, f).select(*a.columns)


def _minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = swept(a, b, keys, ["attr"]).where("a is not null and b is null")
    return left.select(*keys, START, END, "a.attr").select(*a.columns)


def _common(a: DataFrame, b: DataFrame, keys: list[str], f: Combine) -> DataFrame:
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(START).alias("__s"), F.col(END).alias("__e"), F.col("attr").alias("__r"))
    on = overlaps(F.col(START), F.col(END), F.col("__s"), F.col("__e"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    out = a.join(other, on).withColumns({START: F.greatest(START, "__s"), END: F.least(END, "__e"), "attr": f(F.col("attr"), F.col("__r"))})
    return out.select(*a.columns)


def bag_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Tuples of both relations, aligned per key and not combined."""
    left, right = align([a, b], keys)
    return left.unionByName(right)


def union(a: TemporalGraph, b: TemporalGraph, vf: Combine, ef: Combine) -> TemporalGraph:
    """What is in either; attributes are f(left, right) where it is in both."""
    return replace(a, vertex_tuples=_union(a.vertices, b.vertices, V_KEY, vf), edge_tuples=_union(a.edges, b.edges, E_KEY, ef), v_coalesced=False, e_coalesced=False)


def difference(a: TemporalGraph, b: TemporalGraph) -> TemporalGraph:
    """The periods of a's vertices that b has not, and a's edges within them."""
    v = _minus(a.vertices, b.vertices, V_KEY)
    return replace(a, vertex_tuples=v, edge_tuples=_minus(a.edges, b.edges, E_KEY), v_coalesced=False, e_coalesced=False).constrained()


def intersection(a: TemporalGraph, b: TemporalGraph, vf: Combine, ef: Combine) -> TemporalGraph:
    """What is in both, with attributes f(left, right)."""
    return replace(a, vertex_tuples=_common(a.vertices, b.vertices, V_KEY, vf), edge_tuples=_common(a.edges, b.edges, E_KEY, ef), v_coalesced=False, e_coalesced=False)

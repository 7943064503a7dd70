"""Reducers: what becomes of the attributes of tuples that are joined into one.

A reducer is a function (attribute, start) -> aggregate column, or one of the names here. first and last go by
start, so that results do not depend on the order of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Reducer = Callable[[Column, Column], Column]

REDUCERS: dict[str, Reducer] = {
    "min": lambda a, s: F.min(a),
    "max": lambda a, s: F.max(a),
    "sum": lambda a, s: F.sum(a),
    "count": lambda a, s: F.count(a),
    "first": lambda a, s: F.min_by(a, F.struct(s, a)),
    "last": lambda a, s: F.max_by(a, F.struct(s, a)),
    "longest": lambda a, s: F.max_by(a, F.struct(F.length(a), a)),
}

#: What merges results of a reducer into the result over all.
MERGES = {"min": "min", "max": "max", "sum": "sum", "count": "sum", "longest": "longest"}


def reducer(r: str | Reducer) -> Reducer:
    return REDUCERS[r] if isinstance(r, str) else r


def fold(step: Callable[[Column, Column], Column]) -> Reducer:
    """Any binary function, folded over the attributes in the order of start."""

    def run(a: Column, s: Column) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(s.alias("s"), a.alias("a")))), lambda x: x["a"])
        return F.reduce(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0)), lambda x, y: step(x, y))

    return run

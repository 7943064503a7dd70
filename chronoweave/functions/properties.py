"""Property bags: attributes of many values as MAP<STRING, STRING> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bag(**values: Column | str) -> Column:
    """A bag of literal or column values."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def put(bag: Column, name: str, value: Column) -> Column:
    """The bag with a property set; an old value goes."""
    return F.map_concat(drop(bag, name), F.create_map(F.lit(name), value))


def get(bag: Column, name: str) -> Column:
    return F.try_element_at(bag, F.lit(name))


def exists(bag: Column, name: str) -> Column:
    return F.map_contains_key(bag, name)


def drop(bag: Column, name: str) -> Column:
    return F.map_filter(bag, lambda k, v: k != name)


def merged(a: Column, b: Column) -> Column:
    """All properties of both; where both have one, b's."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def names(bag: Column) -> Column:
    return F.array_sort(F.map_keys(bag))


def size(bag: Column) -> Column:
    return F.size(bag)

"""Predicates and arithmetic of closed-open date intervals, as columns. An interval is a pair of DATE columns."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "t_start", "t_end"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date(d: str | datetime.date | Column) -> Column:
    return d if isinstance(d, Column) else F.lit(d if isinstance(d, datetime.date) else datetime.date.fromisoformat(d))


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def contains_date(s: Column, e: Column, d: Column) -> Column:
    return (s <= d) & (d < e)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share at least a day; touching intervals do not."""
    return (s1 < e2) & (s2 < e1)


def touches(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 == e2) | (e1 == s2)


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    return F.least(s1, s2), F.greatest(e1, e2)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """May be empty or turned around: keep rows where start < end."""
    return F.greatest(s1, s2), F.least(e1, e2)


def difference(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """An array of the 0 to 2 intervals (t_start, t_end) of the first that the second does not cover."""
    left = F.struct(s1.alias(START), F.least(e1, s2).alias(END))
    right = F.struct(F.greatest(s1, e2).alias(START), e1.alias(END))
    whole = F.array(F.struct(s1.alias(START), e1.alias(END)))
    parts = F.filter(F.array(left, right), lambda x: x[START] < x[END])
    return F.when(overlaps(s1, e1, s2, e2), parts).otherwise(F.filter(whole, lambda x: x[START] < x[END]))


def is_empty(s: Column, e: Column) -> Column:
    return s == e


def interval_or_null(s: Column, e: Column) -> Column:
    return F.when(s < e, F.struct(s.alias(START), e.alias(END)))


def days(s: Column, e: Column) -> Column:
    return F.datediff(e, s)


def ratio(s: Column, e: Column, of_s: Column, of_e: Column) -> Column:
    """Share of the second interval's days that the first, lying within it, has; 1 if they are equal."""
    return F.when((s == of_s) & (e == of_e), F.lit(1.0)).otherwise(days(s, e) / days(of_s, of_e))


def sort_key(s: Column, e: Column) -> Column:
    """Intervals are ordered by start, then end."""
    return F.struct(s, e)


def as_text(s: Column, e: Column) -> Column:
    return F.format_string("[%s-%s)", s.cast("string"), e.cast("string"))


def seconds(d: Column) -> Column:
    """Epoch seconds of a day's start in UTC, whatever the session's time zone."""
    return F.unix_date(d).cast("long") * 86400


def from_seconds(c: Column) -> Column:
    """The day of epoch seconds, floor-divided."""
    return F.date_add(F.lit(datetime.date(1970, 1, 1)), F.floor(c / 86400).cast("int"))


def min_date(*cols: Column) -> Column:
    return F.least(*cols)


def max_date(*cols: Column) -> Column:
    return F.greatest(*cols)


_NAME = re.compile(r"(\d{4}-\d{2}-\d{2})-(\d{4}-\d{2}-\d{2})$")


def parse(text: str) -> tuple[datetime.date, datetime.date]:
    """The interval at the end of a name, yyyy-mm-dd-yyyy-mm-dd."""
    m = _NAME.search(text)
    if not m:
        raise ValueError(f"no interval in {text!r}")
    s, e = map(datetime.date.fromisoformat, m.groups())
    return checked(s, e)


def checked(s: datetime.date, e: datetime.date) -> tuple[datetime.date, datetime.date]:
    if s > e:
        raise ValueError(f"an interval cannot end ({e}) before it starts ({s})")
    return s, e


def coalesced(intervals: Iterable[tuple[datetime.date, datetime.date]]) -> list[tuple[datetime.date, datetime.date]]:
    """Merges touching and overlapping intervals of a list."""
    out: list[tuple[datetime.date, datetime.date]] = []
    for s, e in sorted(x for x in intervals if x[0] < x[1]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def difference_list(whole: tuple[datetime.date, datetime.date], gone: Iterable[tuple[datetime.date, datetime.date]]) -> list[tuple[datetime.date, datetime.date]]:
    """What of one interval a list of others leaves."""
    at, out = whole[0], []
    for s, e in coalesced(gone):
        if s > at and at < whole[1]:
            out.append((at, min(s, whole[1])))
        at = max(at, e)
    return [*out, (at, whole[1])] if at < whole[1] else out

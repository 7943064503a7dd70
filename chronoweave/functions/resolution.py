"""Calendar resolutions: windows of n days, months or years."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("days", "months", "years")


def _shift(d: datetime.date, months: int) -> datetime.date:
    at = d.year * 12 + d.month - 1 + months
    return datetime.date(at // 12, at % 12 + 1, 1)


def _later(d: datetime.date, months: int) -> datetime.date:
    """The same day so many months later, or that month's last."""
    first = _shift(d, months)
    return first + datetime.timedelta(min(d.day, (_shift(first, 1) - first).days) - 1)


@dataclass(frozen=True)
class Resolution:
    """n of one unit. Day windows start at their anchor, month and year windows at the first of theirs."""

    n: int
    unit: str = "days"

    def __post_init__(self):
        if self.unit not in UNITS or self.n <= 0:
            raise ValueError(f"not a resolution: {self.n} {self.unit}")

    @classmethod
    def parse(cls, text: str) -> Resolution:
        """ISO periods of one unit: P7D, P1W, P3M, P2Y."""
        m = re.fullmatch(r"P(\d+)([DWMY])", text)
        if not m:
            raise ValueError(f"not a period of one unit: {text}")
        n = int(m[1])
        return {"D": cls(n or 1, "days"), "W": cls(7 * n or 7, "days"), "M": cls(n or 1, "months"), "Y": cls(n or 1, "years")}[m[2]] if n else cls(n, "days")

    @classmethod
    def between(cls, s: datetime.date, e: datetime.date) -> Resolution:
        """The whole period from s to e, if it is one of a single unit."""
        months = (e.year - s.year) * 12 + e.month - s.month
        if s.day == e.day and months > 0:
            return cls(months // 12, "years") if months % 12 == 0 else cls(months, "months")
        return cls((e - s).days, "days")

    @property
    def months(self) -> int:
        return 0 if self.unit == "days" else self.n * (12 if self.unit == "years" else 1)

    def window(self, d: datetime.date) -> tuple[datetime.date, datetime.date]:
        """The window that contains a date."""
        if self.unit == "days":
            return d, d + datetime.timedelta(self.n)
        s = datetime.date(d.year, d.month if self.unit == "months" else 1, 1)
        return s, _shift(s, self.months)

    def nth(self, first: datetime.date, i: int) -> tuple[datetime.date, datetime.date]:
        """The i-th period from the date `first` on; a month's last day stands for days it lacks."""
        if self.unit == "days":
            s = first + datetime.timedelta(self.n * i)
            return s, s + datetime.timedelta(self.n)
        return _later(first, self.months * i), _later(first, self.months * (i + 1))

    def minus(self, d: datetime.date) -> datetime.date:
        """Where the window before the one that contains d starts."""
        return d - datetime.timedelta(self.n) if self.unit == "days" else _shift(self.window(d)[0], -self.months)

    def number_between(self, s: datetime.date, e: datetime.date) -> int:
        """Whole windows from s to e."""
        if self.unit == "days":
            return (e - s).days // self.n
        months = (e.year - s.year) * 12 + e.month - s.month - (e.day < s.day)
        return months // self.months

    def parts(self, larger: Resolution, at: datetime.date) -> int:
        """How many of these windows the larger window at a date has."""
        if not self.compatible(larger):
            raise ValueError(f"{larger} is not made of {self}")
        return self.number_between(*larger.window(at))

    def compatible(self, larger: Resolution) -> bool:
        """Whether windows of the larger resolution are made of whole windows of this one."""
        if self.unit == "days":
            return larger.n % self.n == 0 if larger.unit == "days" else self.n == 1
        return bool(larger.months) and larger.months % self.months == 0

    def greater(self, other: Resolution) -> bool:
        size = lambda r: r.n if r.unit == "days" else 30.4375 * r.months
        return size(self) > size(other)

    # The same, as columns. Windows are numbered from the one that contains the anchor.

    def anchor(self, first: Column) -> Column:
        return {"days": first, "months": F.trunc(first, "MM"), "years": F.trunc(first, "YEAR")}[self.unit]

    def index(self, d: Column, anchor: Column) -> Column:
        """The number of the window that contains d; anchor is a window's start."""
        if self.unit == "days":
            return F.floor(F.datediff(d, anchor) / self.n).cast("int")
        months = (F.year(d) - F.year(anchor)) * 12 + F.month(d) - F.month(anchor)
        return F.floor(months / self.months).cast("int")

    def start(self, i: Column, anchor: Column) -> Column:
        return F.date_add(anchor, i * self.n) if self.unit == "days" else F.add_months(anchor, i * self.months)

    def nth_of(self, first: Column, i: Column) -> tuple[Column, Column]:
        """As nth."""
        at = lambda k: F.date_add(first, k * self.n) if self.unit == "days" else F.add_months(first, k * self.months)
        return at(i), at(i + 1)

    def before(self, d: Column) -> Column:
        """As minus."""
        return F.date_sub(d, self.n) if self.unit == "days" else F.add_months(self.anchor(d), -self.months)

    def count_between(self, s: Column, e: Column) -> Column:
        """As number_between, for s not after e."""
        if self.unit == "days":
            return F.floor(F.datediff(e, s) / self.n).cast("int")
        months = (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s) - (F.day(e) < F.day(s)).cast("int")
        return F.floor(months / self.months).cast("int")

    def windows_of(self, s: Column, e: Column, anchor: Column) -> Column:
        """The array of numbers of the windows that [s, e) meets."""
        return F.sequence(self.index(s, anchor), self.index(F.date_sub(e, 1), anchor))


WEEK = Resolution(7, "days")


def split(s: Column, e: Column, resolution: Resolution, mark: Column) -> Column:
    """The pieces of [s, e) by calendar windows, newest first: array of (t_start, t_end, w_start, w_end).

    Windows are anchored at the mark's window; a mark after the start is an error.
    """
    anchor = resolution.anchor(mark)

    def piece(i: Column) -> Column:
        w, v = resolution.start(i, anchor), resolution.start(i + 1, anchor)
        return F.struct(F.greatest(s, w).alias("t_start"), F.least(e, v).alias("t_end"), w.alias("w_start"), v.alias("w_end"))

    pieces = F.reverse(F.transform(resolution.windows_of(s, e, anchor), piece))
    return F.when(mark > s, F.raise_error(F.lit("the mark is after the interval's start"))).otherwise(pieces)

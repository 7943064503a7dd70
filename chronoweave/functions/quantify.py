"""Quantifiers: whether covering some of a window's days is enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Quantifier:
    """covered days > threshold * window days, or >= if not strict. On integers, so nothing is lost in sums."""

    threshold: float
    strict: bool = True

    def __call__(self, covered: Column, window: Column) -> Column:
        return covered > window * self.threshold if self.strict else covered >= window * self.threshold

    def keeps(self, ratio: float) -> bool:
        return ratio > self.threshold if self.strict else ratio >= self.threshold


Always = Quantifier(0.99)
Exists = Quantifier(0.0)
Most = Quantifier(0.5)


def AtLeast(ratio: float) -> Quantifier:  # noqa: N802
    return Quantifier(ratio, strict=False)

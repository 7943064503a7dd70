"""The graph by elementary intervals, for what is dealt by snapshot: a row for each snapshot in which a tuple holds.

Analytics do not go through this: they keep intervals, and cut them only where the values they meet change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START

from .graph import TemporalGraph
from .storage import written


@dataclass(frozen=True)
class Snapshots:
    """v (vid, t, attr), e (eid, src, dst, t, attr) and sequence (idx, t_start, t_end)."""

    v: DataFrame
    e: DataFrame
    sequence: DataFrame


def snapshots(g: TemporalGraph) -> Snapshots:
    """Tuples by snapshot number. Boundaries of tuples are boundaries of the sequence, so equi joins do;
    the sequence, a row for each day at most, is broadcast."""
    seq = written(g.sequence(), "sequence")
    starts = F.broadcast(seq.select(F.col(START).alias("__sd"), F.col("idx").alias("__i")))
    ends = F.broadcast(seq.select(F.col(END).alias("__ed"), F.col("idx").alias("__j")))

    def exploded(df: DataFrame) -> DataFrame:
        each = df.join(starts, F.col(START) == F.col("__sd")).join(ends, F.col(END) == F.col("__ed"))
        return each.withColumn("t", F.explode(F.sequence("__i", "__j"))).drop("__sd", "__ed", "__i", "__j", START, END)

    return Snapshots(exploded(g.vertices), exploded(g.edges), seq)

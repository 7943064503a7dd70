"""The evolving graph: two DataFrames of tuples that hold over closed-open intervals."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from chronoweave.functions.interval import END, START, contains_date, date, from_seconds

from . import normalize
from .normalize import E_KEY, V_KEY
from .storage import written

V_COLUMNS = ["vid", START, END, "attr"]
E_COLUMNS = ["eid", "src", "dst", START, END, "attr"]


@dataclass(frozen=True)
class TemporalGraph:
    """vertex_tuples (vid, t_start, t_end, attr) and edge_tuples (eid, src, dst, t_start, t_end, attr).

    `vertices` and `edges` are coalesced on access, unless a flag says the tuples are already. Operators
    return new graphs and never look at data while a plan is being built.
    """

    vertex_tuples: DataFrame
    edge_tuples: DataFrame
    v_coalesced: bool = False
    e_coalesced: bool = False
    name: str = ""
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, coalesced: bool = False, eager: bool | None = None) -> TemporalGraph:
        """A graph of relations with these column names; eager, by default the session's chronoweave.coalesce = eager, coalesces at once."""
        if eager is None:
            eager = vertices.sparkSession.conf.get("chronoweave.coalesce", "lazy") == "eager"
        g = cls(vertices.select(*V_COLUMNS), edges.select(*E_COLUMNS), coalesced, coalesced)
        return g.coalesced() if eager else g

    @classmethod
    def from_positions(cls, vertices: DataFrame, edges: DataFrame) -> TemporalGraph:
        """Columns by position, times as epoch seconds; without an attribute it is structure only (true)."""

        def named(df: DataFrame, names: list[str]) -> DataFrame:
            cols = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)]
            df = df.select(*cols)
            df = df if "attr" in df.columns else df.withColumn("attr", F.lit(True))
            return df.withColumns({START: from_seconds(F.col(START)), END: from_seconds(F.col(END))})

        return cls.of(named(vertices, V_COLUMNS), named(edges, E_COLUMNS))

    @classmethod
    def empty(cls, spark: SparkSession, v_type: str = "string", e_type: str = "int") -> TemporalGraph:
        v = spark.createDataFrame([], f"vid long, {START} date, {END} date, attr {v_type}")
        e = spark.createDataFrame([], f"eid long, src long, dst long, {START} date, {END} date, attr {e_type}")
        return cls(v, e, True, True)

    @cached_property
    def vertices(self) -> DataFrame:
        return self.vertex_tuples if self.v_coalesced else normalize.coalesce(self.vertex_tuples, V_KEY)

    @cached_property
    def edges(self) -> DataFrame:
        return self.edge_tuples if self.e_coalesced else normalize.coalesce(self.edge_tuples, E_KEY)

    def coalesced(self) -> TemporalGraph:
        return replace(self, vertex_tuples=self.vertices, edge_tuples=self.edges, v_coalesced=True, e_coalesced=True)

    def named(self, name: str) -> TemporalGraph:
        return replace(self, name=name)

    def span(self) -> DataFrame:
        """One row (t_start, t_end): the lifetime, by vertices. Nulls if there are none."""
        return self.vertex_tuples.agg(F.min(START).alias(START), F.max(END).alias(END))

    def sequence(self) -> DataFrame:
        """Elementary intervals of vertices and edges, gaps included (idx, t_start, t_end)."""
        return normalize.sequence(self.vertices, self.edges)

    def snapshot(self, at: str | datetime.date) -> tuple[DataFrame, DataFrame]:
        """(vid, attr) and (eid, src, dst, attr) that hold on a day."""
        here = contains_date(F.col(START), F.col(END), date(at))
        return self.vertices.where(here).select("vid", "attr"), self.edges.where(here).select("eid", "src", "dst", "attr")

    def triplets(self) -> DataFrame:
        return normalize.triplets(self.vertices, self.edges)

    def constrained(self) -> TemporalGraph:
        return replace(self, edge_tuples=normalize.constrain_edges(self.vertex_tuples, self.edge_tuples), e_coalesced=False)

    def violations(self) -> DataFrame:
        """Edge periods in which an end does not exist; empty for a valid graph."""
        rows = normalize.swept(self.edges, normalize.constrain_edges(self.vertices, self.edges), E_KEY, ["attr"]).where("a is not null and b is null")
        return normalize.coalesce(rows.select(*E_KEY, START, END, "a.attr").select(*E_COLUMNS), E_KEY)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> TemporalGraph:
        return replace(self, vertex_tuples=self.vertex_tuples.persist(level), edge_tuples=self.edge_tuples.persist(level))

    def unpersist(self) -> TemporalGraph:
        self.vertex_tuples.unpersist()
        self.edge_tuples.unpersist()
        return self

    def materialize(self) -> TemporalGraph:
        """Persists both relations and computes them."""
        g = self.persist()
        g.vertex_tuples.count(), g.edge_tuples.count()
        return g

    def stored(self) -> TemporalGraph:
        """The coalesced graph as written tables, for what reads its relations several times."""
        return replace(self, vertex_tuples=written(self.vertices, "vertices"), edge_tuples=written(self.edges, "edges"), v_coalesced=True, e_coalesced=True)

    def num_partitions(self) -> tuple[int, int]:
        return self.vertex_tuples.rdd.getNumPartitions(), self.edge_tuples.rdd.getNumPartitions()

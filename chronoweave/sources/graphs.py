"""Reading and writing evolving graphs as Parquet, and point and history queries over them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.interval import END, START, checked, contains_date, date, from_seconds, overlaps, parse, seconds
from chronoweave.plans.graph import TemporalGraph

Bounds = tuple[datetime.date | None, datetime.date | None]
V_KEYS, E_KEYS = ["vid", "estart", "eend"], ["eid", "vid1", "vid2", "estart", "eend"]


def default_of(kind: T.DataType) -> Column:
    """What stands for a missing attribute of a type."""
    values = {T.StringType: "", T.IntegerType: -1, T.LongType: -1, T.DoubleType: -1.0, T.BooleanType: False}
    return F.lit(values.get(type(kind))).cast(kind)


def group_paths(spark: SparkSession, root: str, kind: str, layout: str, group: str, bounds: Bounds = (None, None)) -> list[str]:
    """Directories `<kind>_<layout>_<group>_yyyy-mm-dd-yyyy-mm-dd` under root whose interval meets the bounds.

    Listed by Hadoop's file system, so any store that Spark reads will do.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if name.startswith(f"{kind}_{layout}_{group}_"):
            s, e = parse(name)
            if (bounds[0] is None or e > bounds[0]) and (bounds[1] is None or s < bounds[1]):
                out.append(status.getPath().toString())
    return sorted(out)


def _read(spark: SparkSession, paths: Sequence[str], keys: list[str], attr: int | str | None, bounds: Bounds) -> DataFrame:
    """One relation, clipped to the bounds; the filters are on stored columns, so they reach the scan."""
    df = spark.read.parquet(*paths)
    lo, hi = (None if d is None else F.lit(int(datetime.datetime(d.year, d.month, d.day, tzinfo=datetime.UTC).timestamp())) for d in bounds)
    if lo is not None:
        df = df.where(F.col("eend") > lo)
    if hi is not None:
        df = df.where(F.col("estart") < hi)
    clipped = {} if lo is None else {"estart": F.greatest("estart", lo)}
    df = df.withColumns(clipped | ({} if hi is None else {"eend": F.least("eend", hi)}))
    extra = [c for c in df.columns if c not in keys]
    if isinstance(attr, int):  # 1-based among the attributes; -1 for none
        if attr == -1:
            attr = None
        elif attr <= len(extra):
            attr = extra[attr - 1]
        elif keys is V_KEYS:
            raise ValueError(f"vertices have {len(extra)} attributes, not {attr}")
        else:
            attr = None
    value = F.lit(True) if attr is None else F.coalesce(F.col(f"`{attr}`"), default_of(df.schema[attr].dataType))
    names = {"vid1": "src", "vid2": "dst"}
    ids = [F.col(k).cast("long").alias(names.get(k, k)) for k in keys if k not in ("estart", "eend")]
    return df.select(*ids, from_seconds(F.col("estart")).alias(START), from_seconds(F.col("eend")).alias(END), value.alias("attr"))


def load_graph(spark: SparkSession, root: str, v_attr: int | str | None = None, e_attr: int | str | None = None, bounds: Bounds = (None, None), layout: str = "t", group: str | None = None) -> TemporalGraph:
    """The graph stored under root: `nodes` and `edges`, or, with a group, the directories whose names carry intervals.

    Attributes are chosen by name or by 1-based place; None or -1 is structure only. Without a group, the session's
    chronoweave.partitions.sgroup is taken, if it is set.
    """
    if group is None:
        group = spark.conf.get("chronoweave.partitions.sgroup", "")
    if bounds[0] and bounds[1]:
        checked(*bounds)
    if group:
        v, e = (group_paths(spark, root, kind, layout, group, bounds) for kind in ("nodes", "edges"))
        if not v or not e:
            return TemporalGraph.empty(spark)
    else:
        v, e = [f"{root}/nodes"], [f"{root}/edges"]
    return TemporalGraph(_read(spark, v, V_KEYS, v_attr, bounds), _read(spark, e, E_KEYS, e_attr, bounds))


def save_graph(g: TemporalGraph, root: str, layout: str = "t", group: str = "", interval: tuple[datetime.date, datetime.date] | None = None, mode: str = "errorifexists") -> None:
    """Writes both relations, times as epoch seconds; layout t sorts by id (for histories), s by start (for snapshots)."""
    tail = f"_{layout}_{group}_{interval[0]}-{interval[1]}" if group and interval else ""
    times = [seconds(F.col(START)).alias("estart"), seconds(F.col(END)).alias("eend")]
    v = g.vertices.select("vid", *times, "attr")
    e = g.edges.select("eid", F.col("src").alias("vid1"), F.col("dst").alias("vid2"), *times, "attr")
    for df, name, key in ((v, "nodes", "vid"), (e, "edges", "eid")):
        order = [key, "estart"] if layout == "t" else ["estart", key]
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{root}/{name}{tail}")


# Point and history queries: plain filters, so that they reach the scan.


def node_at(g: TemporalGraph, vid: int, at: str | datetime.date) -> DataFrame:
    """The vertex's attribute on a day; no row if it does not exist then."""
    return g.vertex_tuples.where((F.col("vid") == vid) & contains_date(F.col(START), F.col(END), date(at))).select("vid", "attr")


def edge_at(g: TemporalGraph, eid: int, at: str | datetime.date) -> DataFrame:
    return g.edge_tuples.where((F.col("eid") == eid) & contains_date(F.col(START), F.col(END), date(at))).select("eid", "src", "dst", "attr")


def node_history(g: TemporalGraph, vid: int, start: str | datetime.date, end: str | datetime.date) -> DataFrame:
    """The vertex's tuples that meet [start, end), whole."""
    return g.vertices.where((F.col("vid") == vid) & overlaps(F.col(START), F.col(END), date(start), date(end)))


def edge_history(g: TemporalGraph, eid: int, start: str | datetime.date, end: str | datetime.date) -> DataFrame:
    return g.edges.where((F.col("eid") == eid) & overlaps(F.col(START), F.col(END), date(start), date(end)))


def snapshot_scan(spark: SparkSession, root: str, at: datetime.date, v_attr: int | str | None = None, group: str = "") -> tuple[DataFrame, DataFrame]:
    """The graph on a day straight from files: (vid, attr) and (src, dst), edge ids dropped."""
    day = (at, at + datetime.timedelta(1))
    v, e = load_graph(spark, root, v_attr, None, day, "s", group).snapshot(at)
    return v, e.select("src", "dst")

"""Evolving graphs made of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import constrain_edges, tasks_for

SUPPLIERS = 1_000_000_000


def _social(events: DataFrame) -> TemporalGraph:
    day = F.to_date("ts")
    period = [day.alias(START), F.date_add(day, 1).alias(END)]
    v = events.groupBy(F.col("user_id").alias("vid"), *period).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("attr"))
    next_user = F.lead("user_id").over(Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))
    steps = events.select(F.col("user_id").alias("src"), next_user.alias("dst"), *period).where("src != dst")
    e = steps.groupBy("src", "dst", START, END).agg(F.count("*").cast("int").alias("attr"))
    return TemporalGraph.of(v, e.withColumn("eid", F.col("src") * 1_000_000 + F.col("dst")))


def social(spark: SparkSession, sf_dir: str, part: str = "") -> TemporalGraph:
    """Users of events, and who follows whom within an hour, by day; the edge attribute counts it.

    For operations on two graphs, part "a" is the graph of all events, "b" that of the purchases among them.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    if part == "b":
        events = events.where(F.col("event_type") == "purchase")
    return _social(events)


def trade(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    """Customers from order to order (the last period ends 2001-09-01) and suppliers all the time; edges are the
    quantities a customer orders from a supplier in a month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
    n = tasks_for(orders, suppliers, lines)
    days = orders.repartition(n, "o_custkey").groupBy(F.col("o_custkey").alias("vid"), F.col("d").alias(START)).agg(F.max("o_orderpriority").alias("attr"))
    end = F.coalesce(F.lead(START).over(Window.partitionBy("vid").orderBy(START)), F.lit("2001-09-01").cast("date"))
    customers = days.select("vid", START, end.alias(END), "attr").where(f"{START} < {END}")
    suppliers = suppliers.select((F.col("s_suppkey") + SUPPLIERS).alias("vid"), F.lit("1995-01-01").cast("date").alias(START), F.lit("2001-09-01").cast("date").alias(END), F.lit("S").alias("attr"))
    v = customers.unionByName(suppliers.repartition(n, "vid"))
    sold = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).repartition(n, "o_custkey")
    month = F.trunc("d", "MM")
    e = sold.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"), month.alias(START)).agg(F.sum("l_quantity").cast("long").alias("attr"))
    e = e.withColumns({END: F.add_months(START, 1), "eid": F.col("src") * 1_000_000 + F.col("dst") - SUPPLIERS})
    g = TemporalGraph.of(v, e)
    return TemporalGraph.of(v, constrain_edges(g.vertex_tuples, g.edge_tuples))

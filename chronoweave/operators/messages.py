"""One round of messages along edges, and supersteps of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.normalize import V_KEY, attached, islands, overlap_join, swept, temporal_aggregate
from chronoweave.plans.storage import written

#: Columns of an edge (and its ends) to messages by receiver, "src" or "dst"; a null message is not sent.
Send = Callable[[dict[str, Column]], dict[str, Column]]


def _sent(rows: DataFrame, send: Send) -> DataFrame:
    messages = send({c: F.col(c) for c in rows.columns})
    if not set(messages) <= {"src", "dst"}:
        raise ValueError(f"messages go to src or dst, not {sorted(messages)}")
    each = F.array(*[F.struct(F.col(to).alias("to"), m.alias("msg")) for to, m in messages.items()])
    return rows.withColumn("__m", F.explode(each)).where("__m.msg is not null").withColumns({"vid": F.col("__m.to"), "msg": F.col("__m.msg")})


def aggregate_messages(g: TemporalGraph, send: Send, merge: Callable[[Column], Column], default: Column, endpoints: bool = False) -> DataFrame:
    """Vertices with agg: what merge makes of the messages they get in each period, or the default.

    With endpoints, messages may read src_attr and dst_attr, and hold while these and the edge do.
    """
    sent = _sent(g.triplets() if endpoints else g.edges, send).select("vid", START, END, "msg")
    got = temporal_aggregate(sent, V_KEY, [merge(F.col("msg")).alias("agg")])
    return attached(g.vertices, got, {"agg": F.coalesce("agg", default)})


def pregel(
    g: TemporalGraph, initial: Column, max_iterations: int, vprog: Callable[[Column, Column, Column], Column], send: Send, merge: Callable[[Column], Column],
    start: Callable[[Column, Column], Column] = lambda vid, attr: attr, direction: str = "either",
) -> DataFrame:
    """Bulk-synchronous supersteps at all times at once: vertices with value.

    value begins as start(vid, attr); all vertices get the initial message; then receivers run
    vprog(vid, value, message). Edges send if their src ("out"), dst ("in"), one ("either") or both ends
    ("both") ran last. It ends when nothing is sent. send sees src_value and dst_value. Values hold over
    intervals, cut only where a vertex gets other messages; they must be comparable.
    """
    active = {"out": "src_on", "in": "dst_on", "either": "src_on or dst_on", "both": "src_on and dst_on"}[direction]
    first = g.vertices.select("vid", START, END, vprog(F.col("vid"), start(F.col("vid"), F.col("attr")), initial).alias("value"), F.lit(True).alias("on"))
    columns, e = ["vid", "value", "on"], written(g.edges, "edges")
    state = written(islands(first, columns), "state")
    for _ in range(max_iterations):
        rows = e
        for end in ("src", "dst"):
            of_end = state.select(F.col("vid").alias("__v"), F.col("value").alias(f"{end}_value"), F.col("on").alias(f"{end}_on"), F.col(START).alias("__s"), F.col(END).alias("__e"))
            rows = overlap_join(rows, of_end, F.col(end) == F.col("__v"), ("__s", "__e")).drop("__v")
        sent = _sent(rows.where(active), send).select("vid", START, END, "msg")
        got = written(temporal_aggregate(sent, V_KEY, [merge(F.col("msg")).alias("msg")]), "messages")
        if got.isEmpty():
            break
        step = swept(state, got, V_KEY, ["value"], ["msg"]).where("a is not null").select("vid", START, END, "a.value", "b.msg")
        ran = F.when(F.col("msg").isNotNull(), vprog(F.col("vid"), F.col("value"), F.col("msg"))).otherwise(F.col("value"))
        state = written(islands(step.select("vid", START, END, ran.alias("value"), F.col("msg").isNotNull().alias("on")), columns), "state")
    return attached(g.vertices, state.drop("on"), {"value": F.col("value")})

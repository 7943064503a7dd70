"""The plan fragments that all operators are made of: coalescing, alignment, overlap joins, integrity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.interval import END, START, overlaps

from .storage import written

V_KEY, E_KEY = ["vid"], ["eid", "src", "dst"]

#: Bytes of the input's files for one task. Rows of graphs take some ten times as much in a sort.
TASK_BYTES = 4 << 20


def tasks_for(*dfs: DataFrame) -> int:
    """Into how many tasks relations made of so many bytes of files are dealt; looks at the sizes of the files only.

    Adaptive execution aims at bytes of compressed shuffle, which for sorted ids and days are a small part of what a
    task holds of them, and at no more tasks than the session starts with; a number given to repartition stands.
    """
    files = {}
    for df in dfs:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                files[leaf.relation().location().rootPaths().mkString(",")] = leaf.relation().sizeInBytes()
    return max(dfs[0].sparkSession.sparkContext.defaultParallelism, -(-sum(files.values()) // TASK_BYTES))


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """df with the place of each row in an order, from 1.

    Ranges of the order are sorted by tasks of their own and written, so that they stay as they are; a range's first
    place is the number of rows in those before it. No task sees more than a range and a row for each range.
    """
    ranged = df.repartitionByRange(tasks_for(df), *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged, part = written(ranged, "ordered"), F.shiftright("__m", 33)  # the task's number; the rest counts its rows
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    firsts = F.broadcast(sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__o")))
    place = F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(firsts, part == F.col("__p")).withColumn(out, place).drop("__m", "__p", "__o")


def islands(df: DataFrame, keys: Sequence[str], touching: bool = True) -> DataFrame:
    """(keys, t_start, t_end) with overlapping and, if asked, touching intervals of equal keys merged.

    One shuffle by keys: a running maximum of ends marks where an island begins.
    """
    order = Window.partitionBy(*keys).orderBy(START, END)
    reach = F.max(END).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = reach.isNull() | (F.col(START) > reach if touching else F.col(START) >= reach)
    marked = df.select(*keys, START, END).where(F.col(START) < F.col(END)).withColumn("__b", begins.cast("int"))
    numbered = marked.withColumn("__i", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__i").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("__i")


def coalesce(df: DataFrame, keys: Sequence[str], attr: str = "attr") -> DataFrame:
    """Merges tuples of equal key and attribute that touch or overlap; columns keep their order."""
    return islands(df, [*keys, attr]).select(*df.columns)


def coalesce_structure(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods of existence: as coalesce, without regard to attributes."""
    return islands(df, keys)


def combine(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merges overlapping intervals only; touching ones stay apart."""
    return islands(df, keys, touching=False)


def boundaries(*dfs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct dates (keys, d) at which something starts or ends."""
    out = None
    for df in dfs:
        one = df.select(*keys, F.explode(F.array(START, END)).alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def elementary(bounds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive boundaries of equal keys as intervals (keys, t_start, t_end), gaps included."""
    w = Window.partitionBy(*keys).orderBy("d")
    return bounds.select(*keys, F.col("d").alias(START), F.lead("d").over(w).alias(END)).where(f"{END} is not null")


def sequence(*dfs: DataFrame) -> DataFrame:
    """The temporal sequence of relations: elementary intervals with idx from 0. At most one row a day."""
    w = Window.partitionBy().orderBy("d")
    b = boundaries(*dfs)
    return b.select((F.row_number().over(w) - 1).alias("idx"), F.col("d").alias(START), F.lead("d").over(w).alias(END)).where(f"{END} is not null")


def pieces(df: DataFrame, cuts: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """df cut at its keys' elementary intervals: an equi join with the overlap as a residual.

    With salts, a key's tuples are dealt to so many tasks, and its intervals, one a day at most, go to all of them.
    """
    c = cuts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(START).alias("__s"), F.col(END).alias("__e"))
    if salts > 1:
        c = c.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        df = df.withColumn("__salt", F.pmod(F.hash(START, END), F.lit(salts)))
    on = (F.col("__s") >= F.col(START)) & (F.col("__e") <= F.col(END))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    if salts > 1:
        on = on & (F.col("__salt") == F.col("__salt2"))
    rest = [x for x in df.columns if x not in (START, END, "__salt")]
    return df.join(c, on).select(*rest, F.col("__s").alias(START), F.col("__e").alias(END))


def align(dfs: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """Relations cut so that tuples of equal keys have equal or disjoint intervals. Splits only where the key changes."""
    cuts = elementary(boundaries(*dfs, keys=keys), keys)
    return [pieces(df, cuts, keys) for df in dfs]


def overlap_join(a: DataFrame, b: DataFrame, on: Column, b_interval: tuple[str, str], how: str = "inner") -> DataFrame:
    """a join b on equal keys where intervals overlap; t_start and t_end become the intersection, b's are dropped."""
    s, e = F.col(b_interval[0]), F.col(b_interval[1])
    out = a.join(b, on & overlaps(F.col(START), F.col(END), s, e), how)
    return out.withColumns({START: F.greatest(F.col(START), s), END: F.least(F.col(END), e)}).drop(*b_interval)


def constrain_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges clipped to the periods in which both ends exist."""
    n = tasks_for(vertices, edges)
    life = coalesce_structure(vertices.repartition(n, *V_KEY), V_KEY)
    out = edges
    for end in ("src", "dst"):
        v = life.select(F.col("vid").alias("__v"), F.col(START).alias("__s"), F.col(END).alias("__e"))
        out = overlap_join(out.repartition(n, end), v, F.col(end) == F.col("__v"), ("__s", "__e")).drop("__v")
    return out.select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, t_start, t_end) of edges and of their reverses; a self-loop counts twice."""
    return edges.select("src", "dst", START, END).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), START, END))


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with src_attr and dst_attr, cut where either changes."""
    out = edges
    for end in ("src", "dst"):
        v = vertices.select(F.col("vid").alias("__v"), F.col(START).alias("__s"), F.col(END).alias("__e"), F.col("attr").alias(f"{end}_attr"))
        out = overlap_join(out, v, F.col(end) == F.col("__v"), ("__s", "__e")).drop("__v")
    return out.select("eid", "src", "dst", START, END, "attr", "src_attr", "dst_attr")


def temporal_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """A sequenced group-by: (keys, t_start, t_end, aggregates) over every elementary interval of the key."""
    (cut,) = align([df], keys)
    return cut.groupBy(*keys, START, END).agg(*aggregates)


def merged_aggregate(df: DataFrame, keys: Sequence[str], first: Column, merge: Column, attr: str = "attr") -> DataFrame:
    """(keys, t_start, t_end, attr) as a sequenced group-by, for aggregates that merge (first, then merge over attr).

    Tuples of equal key and interval become one before anything is cut, so a key has as many as there are different
    intervals, not as it has members; what is left of a large key is cut by several tasks.
    """
    own = df.groupBy(*keys, START, END).agg(first.alias(attr))
    cuts = elementary(boundaries(own, keys=keys), keys)
    return pieces(own, cuts, keys, salts=16).groupBy(*keys, START, END).agg(merge.alias(attr))


def running_total(df: DataFrame, keys: Sequence[str], weight: Column, out: str) -> DataFrame:
    """For every key and interval the sum of the weights of the tuples that hold there, where it is not 0.

    A sweep over starts (+) and ends (-): one shuffle, no split of tuples.
    """
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col(START).alias("d"), weight.alias("w")), F.struct(F.col(END).alias("d"), (-weight).alias("w")))).alias("x"))
    steps = steps.groupBy(*keys, F.col("x.d").alias("d")).agg(F.sum("x.w").alias("w"))
    order = Window.partitionBy(*keys).orderBy("d")
    total = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    swept = steps.select(*keys, F.col("d").alias(START), F.lead("d").over(order).alias(END), total.alias(out)).where(f"{END} is not null and {out} != 0")
    return islands(swept, [*keys, out])


def summed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, t_start, t_end, value): the sum of the values of a key's tuples, over every period in which any holds.

    As temporal_aggregate with a sum, cut only where something changes, by a sweep: df is computed once and shuffled
    once. The tuples that hold are counted, so what rounding leaves of a sum when its last tuple ends is no value.
    """
    ends = F.array(F.struct(F.col(START).alias("d"), F.col(value).alias("w"), F.lit(1).alias("n")), F.struct(F.col(END).alias("d"), (-F.col(value)).alias("w"), F.lit(-1).alias("n")))
    steps = df.where(F.col(START) < F.col(END)).select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*").repartition(*keys)
    steps = steps.groupBy(*keys, "d").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).where("w != 0 or n != 0")
    order = Window.partitionBy(*keys).orderBy("d")
    now = order.rowsBetween(Window.unboundedPreceding, 0)
    out = steps.select(*keys, F.col("d").alias(START), F.lead("d").over(order).alias(END), F.sum("w").over(now).alias(value), F.sum("n").over(now).alias("__n"))
    return out.where(f"{END} is not null and __n > 0").drop("__n")


def swept(a: DataFrame, b: DataFrame, keys: Sequence[str], a_cols: Sequence[str] = (), b_cols: Sequence[str] = ()) -> DataFrame:
    """(keys, t_start, t_end, a, b): two relations side by side, each of which has one tuple for a key and day at most.

    a and b are structs of the columns of the tuple that holds, null where there is none; periods in which neither
    holds are left out. A sweep over starts and ends: one shuffle by keys, no join, whatever the tuples' lengths.
    """
    rows = None
    for df, cols, mine, other in ((a, a_cols, "a", "b"), (b, b_cols, "b", "a")):
        value = F.struct(F.lit(True).alias("on"), *[F.col(f"`{c}`").alias(c) for c in cols])
        gone = F.struct(F.lit(False).alias("on"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols])
        ends = F.array(F.struct(F.col(START).alias("d"), value.alias("x")), F.struct(F.col(END).alias("d"), gone.alias("x")))
        steps = df.where(F.col(START) < F.col(END)).select(*keys, F.explode(ends).alias("e")).select(*keys, "e.d", F.col("e.x").alias(mine))
        rows = steps if rows is None else rows.unionByName(steps, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("d", F.coalesce(F.col("a.on"), F.col("b.on")))  # at a day, ends come before starts
    now = order.rowsBetween(Window.unboundedPreceding, 0)
    state = [F.last(c, ignorenulls=True).over(now).alias(c) for c in "ab"]
    out = rows.select(*keys, F.col("d").alias(START), F.lead("d").over(order).alias(END), *state).where(f"{START} < {END} and (a.on or b.on)")
    return out.select(*keys, START, END, *[F.when(F.col(f"{c}.on"), F.col(c)).alias(c) for c in "ab"])


def attached(vertices: DataFrame, values: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Vertices with the columns, made from the values (vid, t_start, t_end, ...) that hold at the time or from nulls."""
    own = [c for c in values.columns if c not in (*V_KEY, START, END)]
    rows = swept(vertices, values, V_KEY, ["attr"], own).where("a is not null")
    out = rows.select("vid", START, END, "a.attr", *[F.col(f"b.{c}").alias(c) for c in own]).select("vid", START, END, "attr", *[c.alias(k) for k, c in columns.items()])
    return islands(out, [*V_KEY, "attr", *columns]).select("vid", START, END, "attr", *columns)


def merge_interval_lists(a: DataFrame, b: DataFrame, keys: Sequence[str], f) -> DataFrame:
    """Two interval-to-value relations as one: f(left, right) where both hold, else the one that does."""
    both = swept(a, b, keys, ["attr"], ["attr"])
    value = F.when(F.col("a.attr").isNotNull() & F.col("b.attr").isNotNull(), f(F.col("a.attr"), F.col("b.attr"))).otherwise(F.coalesce("a.attr", "b.attr"))
    return both.select(*keys, START, END, value.alias("attr"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of each tuple of a all tuples of b with its key leave, as tuples of their own. Tuples may overlap.

    b becomes its gaps, the first and the last of them open; a key that b lacks is one gap.
    """
    w = Window.partitionBy(*keys).orderBy(START)
    low, high = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    covered = islands(b, keys)
    placed = covered.select(*[F.col(k).alias(f"__{k}") for k in keys], START, END, F.coalesce(F.lag(END).over(w), low).alias("__l"), F.lead(START).over(w).isNull().alias("__last"))
    before, after = F.struct(F.col("__l").alias("s"), F.col(START).alias("e")), F.struct(F.col(END).alias("s"), high.alias("e"))
    gaps = placed.select(*[f"__{k}" for k in keys], F.explode(F.when(F.col("__last"), F.array(before, after)).otherwise(F.array(before))).alias("g"))
    gaps = gaps.select(*[f"__{k}" for k in keys], "g.s", "g.e")
    gaps = gaps.withColumnsRenamed({"s": "__s", "e": "__e"})
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    left = overlap_join(a, gaps, same, ("__s", "__e")).select(*a.columns)
    whole = a.join(covered.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), same, "left_anti")
    return left.unionByName(whole).where(F.col(START) < F.col(END))


def interval_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common refinement of two sequences."""
    return elementary(boundaries(a, b))


def _within(a: DataFrame, b: DataFrame, span: Callable[[tuple[Column, Column], tuple[Column, Column]], tuple[Column, Column]]) -> DataFrame:
    """The common refinement within a first and a last day, which span makes of those of a and of b.

    One pass over the relations: a row for each day says in which of them something starts or ends there.
    """
    ends = None
    for side, df in (("a", a), ("b", b)):
        one = df.select(F.explode(F.array(*[F.struct(F.col(c).alias("d"), F.lit(side + c).alias("k")) for c in (START, END)])).alias("x")).select("x.*")
        ends = one if ends is None else ends.unionByName(one)
    days = ends.groupBy("d").agg(*[F.bool_or(F.col("k") == side + c).alias(side + c) for side in "ab" for c in (START, END)])
    w = Window.partitionBy()
    first, last = span(*[(F.min(F.when(F.col(side + START), F.col("d"))).over(w), F.max(F.when(F.col(side + END), F.col("d"))).over(w)) for side in "ab"])
    out = days.select(F.col("d").alias(START), F.lead("d").over(w.orderBy("d")).alias(END), first.alias("__lo"), last.alias("__hi"))
    return out.where((F.col(START) >= F.col("__lo")) & (F.col(END) <= F.col("__hi"))).drop("__lo", "__hi")


def interval_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The refinement within the spans' intersection."""
    return _within(a, b, lambda of_a, of_b: (F.greatest(of_a[0], of_b[0]), F.least(of_a[1], of_b[1])))


def interval_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The refinement within the left span."""
    return _within(a, b, lambda of_a, of_b: of_a)

"""One query for every operator, over graphs made of the benchmark tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O  # noqa: N812
from .functions import interval as I  # noqa: N812
from .functions.interval import END, START
from .functions.quantify import Always, AtLeast, Exists, Most
from .functions.resolution import WEEK, Resolution, split
from .functions.series import linear_trend, make_series
from .operators import components, degree, messages, pagerank, paths, select, setops, triangles, zoom
from .operators import partition as parts
from .plans import normalize as N  # noqa: N812
from .plans.graph import TemporalGraph
from .plans.snapshots import snapshots
from .plans.storage import fresh_path
from .sources import graphs, text
from .sources.datasets import social, trade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LO, HI = "2024-01-08", "2024-01-15"
WINDOW = f"DATE '{LO}', DATE '{HI}'"
OVER = f"t_start < DATE '{HI}' AND DATE '{LO}' < t_end"
V, E = f"{O.VK}, attr", f"{O.EK}, attr"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _bounds():
    return I.date(LO), I.date(HI)


# Intervals


@query(f"""WITH {O.SOCIAL} SELECT vid, t_start, t_end, t_start >= DATE '{LO}' AND t_end <= DATE '{HI}' AS within, t_start <= DATE '2024-01-10' AND DATE '2024-01-10' < t_end AS has_day,
{OVER} AS meets, t_start = DATE '{HI}' OR t_end = DATE '{LO}' AS touching, least(t_start, DATE '{LO}') AS hull_start, greatest(t_end, DATE '{HI}') AS hull_end,
CASE WHEN {OVER} THEN greatest(t_start, DATE '{LO}') END AS common_start, CAST(t_end - t_start AS INTEGER) AS days, round((t_end - t_start) / 31.0, 6) AS share,
'[' || t_start || '-' || t_end || ')' AS text, CAST(epoch(t_start) AS BIGINT) AS start_s FROM v""")
def interval_predicates(spark, sf_dir):
    s, e, (lo, hi) = F.col(START), F.col(END), _bounds()
    hull, common = I.hull(s, e, lo, hi), I.intersection(s, e, lo, hi)
    month = I.date("2024-01-01"), I.date("2024-02-01")
    return social(spark, sf_dir).vertices.select(
        "vid", s, e, I.contains(lo, hi, s, e).alias("within"), I.contains_date(s, e, I.date("2024-01-10")).alias("has_day"), I.overlaps(s, e, lo, hi).alias("meets"), I.touches(s, e, lo, hi).alias("touching"),
        hull[0].alias("hull_start"), hull[1].alias("hull_end"), I.interval_or_null(*common)[START].alias("common_start"), I.days(s, e).alias("days"), F.round(I.ratio(s, e, *month), 6).alias("share"), I.as_text(s, e).alias("text"), I.seconds(s).alias("start_s"),
    )


@query(f"""WITH {O.SOCIAL} SELECT vid, t_start, least(t_end, DATE '{LO}') AS t_end, attr FROM v WHERE t_start < least(t_end, DATE '{LO}')
UNION ALL SELECT vid, greatest(t_start, DATE '{HI}'), t_end, attr FROM v WHERE greatest(t_start, DATE '{HI}') < t_end""")
def interval_difference_each(spark, sf_dir):
    v = social(spark, sf_dir).vertices.withColumn("x", F.explode(I.difference(F.col(START), F.col(END), *_bounds())))
    return v.select("vid", F.col("x.t_start"), F.col("x.t_end"), "attr")


@query(f"""WITH {O.TRADE}, w AS (SELECT vid, t_start, t_end, unnest(range(datediff('month', DATE '1995-01-01', t_start), datediff('month', DATE '1995-01-01', t_end - 1) + 1)) AS i FROM v),
x AS (SELECT *, CAST(DATE '1995-01-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS w_start, CAST(DATE '1995-01-01' + to_months(CAST(i + 1 AS INTEGER)) AS DATE) AS w_end FROM w)
SELECT vid, greatest(t_start, w_start) AS t_start, least(t_end, w_end) AS t_end, w_start, w_end FROM x""")
def interval_split_month(spark, sf_dir):
    pieces = split(F.col(START), F.col(END), Resolution(1, "months"), I.date("1995-01-01"))
    return trade(spark, sf_dir).vertices.select("vid", F.explode(pieces).alias("x")).select("vid", "x.*")


# Normalisation and accessors


@query(f"WITH {O.SOCIAL} SELECT vid, t_start, t_end, attr FROM v")
def coalesce_vertices(spark, sf_dir):
    return social(spark, sf_dir).vertices


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, t_start, t_end, attr FROM e")
def coalesce_edges(spark, sf_dir):
    return social(spark, sf_dir).edges


@query(f"WITH {O.SOCIAL} {O.co('v0', O.VK)}")
def coalesce_structure(spark, sf_dir):
    return N.coalesce_structure(social(spark, sf_dir).vertex_tuples, N.V_KEY)


@query(f"WITH {O.SOCIAL}, x AS (SELECT src AS vid, t_start - 1 AS t_start, t_end + 1 AS t_end FROM e0) {O.co('x', O.VK, '<')}")
def combine_overlapping(spark, sf_dir):
    e = social(spark, sf_dir).edge_tuples
    return N.combine(e.select(F.col("src").alias("vid"), F.date_sub(START, 1).alias(START), F.date_add(END, 1).alias(END)), N.V_KEY)


@query(f"WITH {O.SOCIAL}, s AS ({O.seq('v', 'e')}) SELECT CAST(idx AS INTEGER) AS idx, t_start, t_end FROM s")
def temporal_sequence(spark, sf_dir):
    return social(spark, sf_dir).sequence()


@query(f"WITH {O.TRADE} SELECT min(t_start) AS t_start, max(t_end) AS t_end FROM v")
def span(spark, sf_dir):
    return trade(spark, sf_dir).span()


@query(f"WITH {O.TRADE} SELECT eid, src, dst, t_start, t_end, attr FROM e")
def constrain_edges(spark, sf_dir):
    return trade(spark, sf_dir).edges


@query(f"WITH {O.SOCIAL} {O.TRIPLETS}")
def triplets(spark, sf_dir):
    return social(spark, sf_dir).triplets()


_TORN = f"{O.SOCIAL}, torn AS (SELECT * FROM v WHERE attr <> 'click'), {O.life('sl', 'torn')}, k AS ({O.constrained('e', 'sl')}), {O.cut(O.EK, 'tc', 'e', 'k')}, ep AS ({O.on_cut('e', 'tc', O.EK)}), kp AS ({O.on_cut('k', 'tc', O.EK)}), x AS ({O.minus('ep', 'kp', O.EK)})"


@query(f"WITH {_TORN} {O.co('x', E)}")
def integrity_violations(spark, sf_dir):
    """Of a graph whose vertices lack their days of clicks, while its edges stay."""
    g = social(spark, sf_dir)
    return TemporalGraph.of(g.vertex_tuples.where("attr <> 'click'"), g.edge_tuples).violations()


_LEFT = f"{O.SOCIAL}, err AS (SELECT vid, t_start, t_end FROM v WHERE attr = 'error'), {O.cut(O.VK, 'lc', 'v', 'err')}, vp AS ({O.on_cut('v', 'lc', O.VK)}), rp AS ({O.on_cut('err', 'lc', O.VK, 't_start AS s_')}), x AS ({O.minus('vp', 'rp', O.VK)})"


@query(f"WITH {_LEFT} {O.co('x', V)}")
def interval_difference_list(spark, sf_dir):
    """Of each user's periods what all the periods of errors leave."""
    v = social(spark, sf_dir).vertices
    return N.coalesce(N.subtract(v, v.where("attr = 'error'").select("vid", START, END), N.V_KEY), N.V_KEY)


@query(f"""WITH {O.TRADE}, q AS (SELECT * FROM v WHERE vid < 1000000000)
SELECT vid, t_start, t_end, t_start - 7 AS week_before, CAST(date_trunc('month', t_start) - INTERVAL 3 MONTH AS DATE) AS quarter_before, CAST(date_trunc('year', t_start) - INTERVAL 1 YEAR AS DATE) AS year_before,
CAST((t_end - t_start) // 7 AS INTEGER) AS weeks, CAST(((year(t_end) - year(t_start)) * 12 + month(t_end) - month(t_start) - CASE WHEN day(t_end) < day(t_start) THEN 1 ELSE 0 END) // 2 AS INTEGER) AS two_months, CAST(t_start + INTERVAL 6 MONTH AS DATE) AS third_start, CAST(t_start + INTERVAL 8 MONTH AS DATE) AS third_end FROM q""")
def resolution_arithmetic(spark, sf_dir):
    s, e = F.col(START), F.col(END)
    two = Resolution(2, "months")
    third = two.nth_of(s, F.lit(3))
    v = trade(spark, sf_dir).vertices.where("vid < 1000000000")  # customers
    return v.select("vid", s, e, WEEK.before(s).alias("week_before"), Resolution(3, "months").before(s).alias("quarter_before"), Resolution(1, "years").before(s).alias("year_before"),
                    WEEK.count_between(s, e).alias("weeks"), two.count_between(s, e).alias("two_months"), third[0].alias("third_start"), third[1].alias("third_end"))


@query(f"WITH {O.TRADE} SELECT vid, t_start, t_end, t_start = t_end AS empty, row_number() OVER (ORDER BY t_start, t_end, vid) AS place, least(t_start, DATE '1997-01-01') AS low, greatest(t_end, DATE '1997-01-01') AS high FROM v")
def interval_order(spark, sf_dir):
    s, e, day = F.col(START), F.col(END), I.date("1997-01-01")
    placed = N.numbered(trade(spark, sf_dir).vertices, [START, END, "vid"], "place")
    return placed.select("vid", s, e, I.is_empty(s, e).alias("empty"), "place", I.min_date(s, day).alias("low"), I.max_date(e, day).alias("high"))


# Filters and maps


def _sliced(spark, sf_dir):
    return select.slice(social(spark, sf_dir), LO, HI)


@query(f"WITH {O.SOCIAL}, x AS (SELECT vid, attr, greatest(t_start, DATE '{LO}') AS t_start, least(t_end, DATE '{HI}') AS t_end FROM v0 WHERE {OVER}) {O.co('x', V)}")
def slice_v(spark, sf_dir):
    return _sliced(spark, sf_dir).vertices


@query(f"WITH {O.SOCIAL}, x AS (SELECT {E}, greatest(t_start, DATE '{LO}') AS t_start, least(t_end, DATE '{HI}') AS t_end FROM e0 WHERE {OVER}) {O.co('x', E)}")
def slice_e(spark, sf_dir):
    return _sliced(spark, sf_dir).edges


@query(f"WITH {O.SOCIAL} SELECT vid, attr FROM v WHERE t_start <= DATE '{LO}' AND DATE '{LO}' < t_end")
def snapshot_v(spark, sf_dir):
    return social(spark, sf_dir).snapshot(LO)[0]


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, attr FROM e WHERE t_start <= DATE '{LO}' AND DATE '{LO}' < t_end")
def snapshot_e(spark, sf_dir):
    return social(spark, sf_dir).snapshot(LO)[1]


_SUB = f"{O.SOCIAL}, sub AS (SELECT * FROM v WHERE attr <> 'click' AND vid % 3 <> 0), {O.life('lv', 'sub')}, x AS ({O.constrained('e', 'lv')})"


def _subgraph(spark, sf_dir):
    return select.vsubgraph(social(spark, sf_dir), lambda vid, attr, s, e: (attr != "click") & (vid % 3 != 0))


@query(f"WITH {_SUB} SELECT vid, t_start, t_end, attr FROM sub")
def vsubgraph_v(spark, sf_dir):
    return _subgraph(spark, sf_dir).vertices


@query(f"WITH {_SUB} {O.co('x', E)}")
def vsubgraph_e(spark, sf_dir):
    return _subgraph(spark, sf_dir).edges


@query(f"WITH {O.SOCIAL}, sub AS (SELECT * FROM v WHERE t_end - t_start >= 2), {O.life('lv', 'sub')}, x AS ({O.constrained('e', 'lv')}) {O.co('x', E)}")
def vsubgraph_temporal(spark, sf_dir):
    return select.vsubgraph(social(spark, sf_dir), lambda vid, attr, s, e: I.days(s, e) >= 2).edges


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, t_start, t_end, attr FROM e WHERE src > dst AND attr >= 1 AND t_start >= DATE '{LO}'")
def esubgraph(spark, sf_dir):
    return select.esubgraph(social(spark, sf_dir), lambda c: (c["src"] > c["dst"]) & (c["attr"] >= 1) & (c[START] >= I.date(LO))).edges


@query(f"WITH {O.SOCIAL}, t AS ({O.TRIPLETS}), x AS (SELECT * FROM t WHERE src_attr = dst_attr) {O.co('x', E)}")
def esubgraph_triplet(spark, sf_dir):
    return select.esubgraph(social(spark, sf_dir), lambda c: c["src_attr"] == c["dst_attr"], endpoints=True).edges


@query(f"WITH {O.SOCIAL}, x AS (SELECT vid, t_start, t_end, upper(left(attr, 1)) AS attr FROM v) {O.co('x', V)}")
def vmap(spark, sf_dir):
    return select.vmap(social(spark, sf_dir), lambda vid, attr, s, e: F.upper(F.left(attr, F.lit(1)))).vertices


@query(f"WITH {O.SOCIAL}, x AS (SELECT eid, src, dst, t_start, t_end, attr * attr AS attr FROM e) {O.co('x', E)}")
def emap(spark, sf_dir):
    return select.emap(social(spark, sf_dir), lambda c: c["attr"] * c["attr"]).edges


@query(f"WITH {O.SOCIAL} SELECT * FROM v0 WHERE attr = 'view'")
def relation_select(spark, sf_dir):
    return select.select(social(spark, sf_dir).vertex_tuples, F.col("attr") == "view")


# Points and histories


@query(f"WITH {O.SOCIAL} SELECT vid, attr FROM v0 WHERE vid = 5 AND t_start <= DATE '{LO}' AND DATE '{LO}' < t_end")
def node_at(spark, sf_dir):
    return graphs.node_at(social(spark, sf_dir), 5, LO)


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, attr FROM e0 WHERE eid = 2000009 AND t_start <= DATE '{LO}' AND DATE '{LO}' < t_end")
def edge_at(spark, sf_dir):
    return graphs.edge_at(social(spark, sf_dir), 2000009, LO)


@query(f"WITH {O.SOCIAL} SELECT vid, t_start, t_end, attr FROM v WHERE vid = 5 AND {OVER}")
def node_history(spark, sf_dir):
    return graphs.node_history(social(spark, sf_dir), 5, LO, HI)


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, t_start, t_end, attr FROM e WHERE eid = 2000009 AND {OVER}")
def edge_history(spark, sf_dir):
    return graphs.edge_history(social(spark, sf_dir), 2000009, LO, HI)


# Zoom


def _register_zooms():
    def time_query(name: str, which: str, make, resolution: Resolution, vq, eq, ereduce: str, sql: str):
        def run(spark, sf_dir):
            g = zoom.temporal_zoom(make(spark, sf_dir), zoom.TimeSpec(resolution), vq, eq, "first", ereduce)
            return g.vertices if which == "v" else g.edges

        run.__name__ = name
        query(sql)(run)

    quantifiers = {"always": Always, "exists": Exists, "most": Most, "atleast": AtLeast(0.25)}
    for name, eq in (("always", "exists"), ("exists", "exists"), ("most", "exists"), ("atleast", "atleast")):
        for which in "ve":
            sql = O.time_zoom(O.SOCIAL, "min(t_start)", O.WEEK, name, eq, which)
            time_query(f"zoom_week_{name}_{which}", which, social, WEEK, quantifiers[name], quantifiers[eq], "max", sql)
    for name, resolution, n in (("quarter", Resolution(3, "months"), 3), ("year", Resolution(1, "years"), 12)):
        for which in "ve":
            anchor = "CAST(date_trunc('month', min(t_start)) AS DATE)" if n == 3 else "CAST(date_trunc('year', min(t_start)) AS DATE)"
            sql = O.time_zoom(O.TRADE, anchor, O.months(n), "most", "exists", which, "CAST(sum(attr) AS BIGINT)")
            time_query(f"zoom_{name}_{which}", which, trade, resolution, Most, Exists, "sum", sql)

    def change_query(name: str, which: str, n: int, vq: str, eq: str):
        def run(spark, sf_dir):
            g = zoom.temporal_zoom(social(spark, sf_dir), zoom.ChangeSpec(n), quantifiers[vq], quantifiers[eq], "first", "max")
            return g.vertices if which == "v" else g.edges

        run.__name__ = name
        query(O.change_zoom(n, vq, eq, which))(run)

    for n, vq, eq in ((2, "exists", "exists"), (5, "most", "exists")):
        for which in "ve":
            change_query(f"zoom_change_{n}_{which}", which, n, vq, eq)


_register_zooms()

_GROUPS = f"{O.SOCIAL}, m AS (SELECT vid % 10 AS vid, t_start, t_end, attr FROM v), {O.cut(O.VK, 'mc', 'm')}, mp AS ({O.on_cut('m', 'mc', O.VK)})"


def _grouped(spark, sf_dir):
    return zoom.structural_zoom(social(spark, sf_dir), lambda vid, attr: vid % 10, "max")


@query(f"WITH {_GROUPS}, x AS (SELECT vid, t_start, t_end, max(attr) AS attr FROM mp GROUP BY ALL) {O.co('x', V)}")
def attribute_zoom_v(spark, sf_dir):
    return _grouped(spark, sf_dir).vertices


@query(f"WITH {O.SOCIAL}, t AS ({O.TRIPLETS}), x AS (SELECT eid, src % 10 AS src, dst % 10 AS dst, t_start, t_end, attr FROM t) {O.co('x', E)}")
def attribute_zoom_e(spark, sf_dir):
    return _grouped(spark, sf_dir).edges


@query(f"WITH {_GROUPS} SELECT vid AS grp, t_start, t_end, count(*) AS n, min(attr) AS least_attr FROM mp GROUP BY vid, t_start, t_end")
def temporal_aggregate(spark, sf_dir):
    v = social(spark, sf_dir).vertices.withColumn("grp", F.col("vid") % 10)
    return N.temporal_aggregate(v, ["grp"], [F.count("*").alias("n"), F.min("attr").alias("least_attr")])


# Set operations


def _ab(spark, sf_dir):
    return social(spark, sf_dir, "a"), social(spark, sf_dir, "b")


def _union(spark, sf_dir) -> TemporalGraph:
    return setops.union(*_ab(spark, sf_dir), lambda a, b: F.concat(a, b), lambda a, b: a + b)


@query(f"WITH {O.AB_CUT} {O.union('avp', 'bvp', O.VK, 'l.attr || r.attr')}")
def union_v(spark, sf_dir):
    return _union(spark, sf_dir).vertices


@query(f"WITH {O.AB_CUT} {O.union('aep', 'bep', O.EK, 'l.attr + r.attr')}")
def union_e(spark, sf_dir):
    return _union(spark, sf_dir).edges


_MINUS = f"{O.AB_CUT}, dv AS ({O.minus('avp', 'bvp', O.VK)}), de AS ({O.minus('aep', 'bep', O.EK)}), {O.life('dl', 'dv')}, dx AS ({O.constrained('de', 'dl')})"


@query(f"WITH {_MINUS} {O.co('dv', V)}")
def difference_v(spark, sf_dir):
    return setops.difference(*_ab(spark, sf_dir)).vertices


@query(f"WITH {_MINUS} {O.co('dx', E)}")
def difference_e(spark, sf_dir):
    return setops.difference(*_ab(spark, sf_dir)).edges


def _intersection(spark, sf_dir) -> TemporalGraph:
    return setops.intersection(*_ab(spark, sf_dir), lambda a, b: F.concat(a, b), lambda a, b: F.greatest(a, b))


@query(f"WITH {O.AB} {O.common('av', 'bv', O.VK, 'l.attr || r.attr')}")
def intersection_v(spark, sf_dir):
    return _intersection(spark, sf_dir).vertices


@query(f"WITH {O.AB} {O.common('ae', 'be', O.EK, 'greatest(l.attr, r.attr)')}")
def intersection_e(spark, sf_dir):
    return _intersection(spark, sf_dir).edges


@query(f"WITH {O.AB_CUT} SELECT * FROM avp UNION ALL SELECT * FROM bvp")
def bag_union(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return setops.bag_union(a.vertices, b.vertices, N.V_KEY).select("vid", START, END, "attr")


@query(f"WITH {O.AB}, l AS (SELECT src AS vid, t_start, t_end, max(attr) AS attr FROM ae0 GROUP BY ALL), r AS (SELECT src AS vid, t_start, t_end, max(attr) AS attr FROM be0 GROUP BY ALL), "
       f"{O.cut(O.VK, 'c', 'l', 'r')}, lp AS ({O.on_cut('l', 'c', O.VK)}), rp AS ({O.on_cut('r', 'c', O.VK)}) SELECT vid, t_start, t_end, CAST(coalesce(lp.attr, 0) + coalesce(rp.attr, 0) AS INTEGER) AS attr FROM lp FULL JOIN rp USING (vid, t_start, t_end)")
def merge_interval_lists(spark, sf_dir):
    a, b = (g.edge_tuples.groupBy(F.col("src").alias("vid"), START, END).agg(F.max("attr").alias("attr")) for g in _ab(spark, sf_dir))
    return N.merge_interval_lists(a, b, N.V_KEY, lambda x, y: x + y)


# Sequences of two whole relations, the vertices and the edges of trade.

_ALL = f"{O.TRADE}, s AS ({O.seq('v', 'e')})"


def _relations(spark, sf_dir):
    g = trade(spark, sf_dir)
    return g.vertices, g.edges


@query(f"WITH {_ALL} SELECT t_start, t_end FROM s")
def interval_union(spark, sf_dir):
    return N.interval_union(*_relations(spark, sf_dir))


@query(f"WITH {_ALL} SELECT t_start, t_end FROM s WHERE t_start >= (SELECT greatest((SELECT min(t_start) FROM v), (SELECT min(t_start) FROM e))) AND t_end <= (SELECT least((SELECT max(t_end) FROM v), (SELECT max(t_end) FROM e)))")
def interval_intersect(spark, sf_dir):
    return N.interval_intersect(*_relations(spark, sf_dir))


@query(f"WITH {_ALL} SELECT t_start, t_end FROM s WHERE t_start >= (SELECT min(t_start) FROM e) AND t_end <= (SELECT max(t_end) FROM e)")
def interval_difference(spark, sf_dir):
    a, b = _relations(spark, sf_dir)
    return N.interval_difference(b, a)


# Analytics


@query(f"WITH {O.DEGREE} SELECT vid, t_start, t_end, degree FROM deg")
def degree_over_time(spark, sf_dir):
    return degree.degree(social(spark, sf_dir))


@query(f"WITH {O.DEGREE} SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def degree_distribution(spark, sf_dir):
    return degree.degree_distribution(social(spark, sf_dir))


def _count_messages(spark, sf_dir, send, endpoints=False):
    return messages.aggregate_messages(social(spark, sf_dir), send, lambda m: F.count(m), F.lit(0).cast("long"), endpoints)


@query(O.messages("SELECT src AS vid, t_start, t_end FROM e UNION ALL SELECT dst, t_start, t_end FROM e"))
def agg_messages_none(spark, sf_dir):
    return _count_messages(spark, sf_dir, lambda c: {"src": F.lit(1), "dst": F.lit(1)})


@query(O.messages("SELECT dst AS vid, t_start, t_end FROM e WHERE attr = 1 AND src > dst"))
def agg_messages_edge(spark, sf_dir):
    return _count_messages(spark, sf_dir, lambda c: {"dst": F.when((c["attr"] == 1) & (c["src"] > c["dst"]), 1)})


@query(O.messages(f"SELECT dst AS vid, t_start, t_end FROM ({O.TRIPLETS}) WHERE src_attr = 'view'"))
def agg_messages_vertex(spark, sf_dir):
    return _count_messages(spark, sf_dir, lambda c: {"dst": F.when(c["src_attr"] == "view", 1)}, endpoints=True)


def _unpacked(df: DataFrame, s, values: list[str]) -> DataFrame:
    """Coalesced periods by snapshot, so that rounded values compare row by row."""
    seq = F.broadcast(s.select(F.col(START).alias("s"), F.col(END).alias("e")))
    return df.join(seq, (F.col("s") >= F.col(START)) & (F.col("e") <= F.col(END))).select("vid", F.col("s").alias(START), F.col("e").alias(END), *values)


def _ranks(spark, sf_dir, **how):
    g = social(spark, sf_dir).stored()
    return _unpacked(pagerank.pagerank(g, **how), g.sequence(), ["rank"]).withColumn("rank", F.round(F.col("rank") + 1e-9, 6))


@query(O.pagerank(5, "se"))
def pagerank_directed(spark, sf_dir):
    return _ranks(spark, sf_dir, tol=0.0, iterations=5)


@query(O.pagerank(5, "both_ways"))
def pagerank_undirected(spark, sf_dir):
    return _ranks(spark, sf_dir, tol=0.0, iterations=5, directed=False)


@query(O.pagerank(12, "se", tol=0.02))
def pagerank_tolerance(spark, sf_dir):
    return _ranks(spark, sf_dir, tol=0.02, iterations=12)


_CC = f"""WITH RECURSIVE {O.SNAP}, near AS (SELECT DISTINCT t, src, dst FROM both_ways WHERE src <> dst),
r_ AS (SELECT vid, t, vid AS c FROM sv UNION SELECT n.dst, n.t, r_.c FROM r_ JOIN near n ON n.src = r_.vid AND n.t = r_.t WHERE r_.c < n.dst), cc AS (SELECT vid, t, min(c) AS c FROM r_ GROUP BY vid, t) {O.attached('x.c', 'cc', 'component')}"""


@query(_CC)
def connected_components(spark, sf_dir):
    return components.connected_components(social(spark, sf_dir))


def _distances(spark, sf_dir, directed):
    g = social(spark, sf_dir)
    out = paths.shortest_paths(g, [1, 2, 3], directed).select("vid", START, END, F.explode("distances").alias("landmark", "d"))
    return _unpacked(out, g.sequence(), ["landmark", "d"])


@query(O.distances("se", "1, 2, 3"))
def shortest_paths_directed(spark, sf_dir):
    return _distances(spark, sf_dir, True)


@query(O.distances("both_ways", "1, 2, 3"))
def shortest_paths_undirected(spark, sf_dir):
    return _distances(spark, sf_dir, False)


@query(f"WITH {O.TRIANGLES} {O.attached('coalesce(x.n, 0)', 'n_', 'triangles')}")
def triangle_count(spark, sf_dir):
    return triangles.triangle_count(social(spark, sf_dir))


@query(f"WITH {O.TRIANGLES}, k_ AS (SELECT src AS vid, t, count(*) AS k FROM both_ways GROUP BY src, t), cx AS (SELECT vid, t, round(n / (k * (k - 1)), 6) AS c FROM n_ JOIN k_ USING (vid, t)) "
       "SELECT sv.vid, s.t_start, s.t_end, coalesce(cx.c, 0.0) AS ccoeff FROM sv LEFT JOIN cx USING (vid, t) JOIN seq s ON s.idx = sv.t")
def clustering_coefficient(spark, sf_dir):
    g = social(spark, sf_dir)
    return _unpacked(triangles.clustering_coefficient(g), g.sequence(), ["ccoeff"]).withColumn("ccoeff", F.round("ccoeff", 6))


def _register_pregel():
    def send(c):
        return {"dst": F.when(c["src_value"] > c["dst_value"], c["src_value"])}

    def pregel_query(name: str, direction: str, active: str):
        def run(spark, sf_dir):
            return messages.pregel(social(spark, sf_dir), F.lit(-1).cast("long"), 3, lambda vid, value, m: F.greatest(value, m), send, lambda m: F.max(m), start=lambda vid, attr: vid, direction=direction)

        run.__name__ = name
        query(O.pregel(3, active))(run)

    for name, direction, active in (("max_label", "out", "p.on_"), ("in", "in", "q.on_"), ("either", "either", "p.on_ OR q.on_"), ("both", "both", "p.on_ AND q.on_")):
        pregel_query(f"pregel_{name}", direction, active)


_register_pregel()


# Series


def _degrees(spark, sf_dir):
    return degree.degree(social(spark, sf_dir)).withColumnRenamed("degree", "value")


@query(f"WITH {O.POINTS} SELECT vid, round(CASE WHEN count(*) > 1 THEN regr_slope(value, i) END, 6) AS slope FROM points GROUP BY vid")
def trend(spark, sf_dir):
    return linear_trend(_degrees(spark, sf_dir), ["vid"], Resolution(1))


@query(f"WITH {O.POINTS}, f AS (SELECT vid, CAST(unnest(range(0, max(i) + 1)) AS INTEGER) AS i FROM points GROUP BY vid) SELECT vid, i, CAST(coalesce(value, -1) AS INTEGER) AS value FROM f LEFT JOIN points USING (vid, i)")
def series(spark, sf_dir):
    return make_series(_degrees(spark, sf_dir), ["vid"], Resolution(1), F.lit(-1))


# Sources, sinks and partitioning


def _saved(spark, sf_dir, **how) -> str:
    path = fresh_path(spark, "graph")
    graphs.save_graph(social(spark, sf_dir), path, **how)
    return path


@query(f"WITH {O.SOCIAL} SELECT eid, src, dst, t_start, t_end, attr FROM e")
def save_and_load_e(spark, sf_dir):
    return graphs.load_graph(spark, _saved(spark, sf_dir), "attr", "attr").edges


@query(f"WITH {O.SOCIAL}, x AS (SELECT vid, attr, greatest(t_start, DATE '{LO}') AS t_start, least(t_end, DATE '{HI}') AS t_end FROM v WHERE {OVER}) {O.co('x', V)}")
def load_bounds_v(spark, sf_dir):
    path = _saved(spark, sf_dir, group="all", interval=(date(2024, 1, 1), date(2024, 2, 1)))
    return graphs.load_graph(spark, path, 1, 1, (date.fromisoformat(LO), date.fromisoformat(HI)), "t", "all").vertices


@query(f"WITH {O.SOCIAL} SELECT src, dst FROM e WHERE t_start <= DATE '{LO}' AND DATE '{LO}' < t_end")
def snapshot_scan(spark, sf_dir):
    path = _saved(spark, sf_dir, layout="s", group="all", interval=(date(2024, 1, 1), date(2024, 2, 1)))
    return graphs.snapshot_scan(spark, path, date.fromisoformat(LO), 1, "all")[1]


@query(f"WITH {O.SOCIAL} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, attr, CAST(t_start - DATE '2024-01-01' AS INTEGER) AS t FROM e0")
def edge_list_load(spark, sf_dir):
    path = fresh_path(spark, "edges")
    lines = social(spark, sf_dir).edge_tuples.select(F.concat_ws(" ", "src", "dst", "attr").alias("value"), F.col(START).alias("day"))
    lines.write.partitionBy("day").text(path)
    return text.dated_edge_lists(spark, [path], date(2024, 1, 1), Resolution(1), canonical=True)


@query(f"WITH {O.DEGREE} SELECT degree || ' ' || count(*) AS value FROM deg GROUP BY degree")
def degree_sink(spark, sf_dir):
    """The lines of the file that the sink writes."""
    path = fresh_path(spark, "degrees")
    text.write_degree_distribution(degree.degree_distribution(social(spark, sf_dir)), path)
    return spark.read.text(path)


@query(f"WITH {O.SOCIAL} SELECT vid, attr FROM v0 WHERE t_start BETWEEN DATE '{LO}' AND DATE '{HI}'")
def node_list_load(spark, sf_dir):
    """Node lists of days, read for the days between two bounds, both inclusive."""
    path = fresh_path(spark, "nodes")
    lines = social(spark, sf_dir).vertex_tuples.select(F.concat_ws(" ", "vid", "attr").alias("value"), F.col(START).alias("day"))
    lines.write.partitionBy("day").text(path)
    days = [str(date(2024, 1, d)) for d in range(1, 31)]
    return text.node_list(spark, [f"{path}/day={d}" for d in text.in_range(days, date.fromisoformat(LO), date.fromisoformat(HI))])


@query(f"WITH {O.SOCIAL} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, true AS dealt, 'copy' AS name")
def materialized(spark, sf_dir):
    """Counts of a graph that was coalesced, dealt, computed and kept."""
    g = parts.partition_graph(social(spark, sf_dir).coalesced().named("copy"), "edge_partition_2d", 4).materialize()
    out = g.vertices.agg(F.count("*").alias("n_vertices")).join(g.edges.agg(F.count("*").alias("n_edges")), how="cross")
    kept = spark.createDataFrame([r.asDict() for r in out.collect()], "n_vertices long, n_edges long")
    dealt = g.num_partitions() == (4, 4)
    g.unpersist()
    return kept.select("*", F.lit(dealt).alias("dealt"), F.lit(g.name).alias("name"))


def _register_partitions():
    def strategy_query(strategy: str, name: str, n: int, runs: int):
        def run(spark, sf_dir):
            s = snapshots(social(spark, sf_dir))
            out = parts.partition_by(s.e, strategy, n, s.sequence.count(), runs).groupBy("part", F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"))
            return out.select(F.col("part").cast("int").alias("part"), "t", "n")

        run.__name__ = name
        query(O.partition(strategy, n, runs))(run)

    for strategy in parts.STRATEGIES:
        strategy_query(strategy, f"partition_{strategy}", 4, 2)
        if "temporal" in strategy:  # more parts than snapshots
            strategy_query(strategy, f"partition_{strategy}_spread", 70, 2)


_register_partitions()

"""Operators on small graphs with known results."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import interval as I  # noqa: N812
from chronoweave.functions.quantify import Always, Exists, Most
from chronoweave.functions.reducers import fold
from chronoweave.functions.resolution import Resolution
from chronoweave.operators import messages, select, setops, zoom
from chronoweave.operators.components import connected_components
from chronoweave.operators.degree import degree, degree_distribution
from chronoweave.operators.pagerank import pagerank
from chronoweave.operators.paths import shortest_paths
from chronoweave.operators.triangles import clustering_coefficient, triangle_count
from chronoweave.plans import normalize
from chronoweave.plans.graph import TemporalGraph
from chronoweave.plans.snapshots import snapshots

from .graphs import A_E, A_V, B_E, B_V, E1A, E1B, E2, E2B, E3, E4A, E4B, U1, U1B, U8, d, edges, eset, graph, same_e, same_v, vertices, vset

PERIODS = [(1, "John", "2018-07-01", 2022), (1, "John", 2010, 2017), (1, "John", 2017, "2018-07-01"), (2, "Mike", 2014, 2018), (2, "Mike", "2018-02-01", 2020), (3, "Ron", 2009, 2014), (3, "Ron", 2019, 2022), (4, "Julia", "2012-07-14", 2017), (4, "Julia", 2006, "2012-07-14"), (4, "Vera", 2017, "2019-07-14")]


def test_coalesce(spark):
    df = vertices(spark, PERIODS)
    same_v(normalize.coalesce(df, ["vid"]), [(1, "John", 2010, 2022), *PERIODS[3:7], (4, "Julia", 2006, 2017), PERIODS[9]])
    got = sorted((r.vid, r.t_start, r.t_end) for r in normalize.coalesce_structure(df, ["vid"]).collect())
    assert got == [(1, d(2010), d(2022)), (2, d(2014), d(2018)), (2, d("2018-02-01"), d(2020)), (3, d(2009), d(2014)), (3, d(2019), d(2022)), (4, d(2006), d("2019-07-14"))]


def test_coalesce_of_contained_and_empty_tuples(spark):
    df = vertices(spark, [(1, "x", 2001, 2010), (1, "x", 2002, 2005), (1, "x", 2003, 2003), (1, None, 2001, 2002), (1, None, 2002, 2003)])
    same_v(normalize.coalesce(df, ["vid"]), [(1, "x", 2001, 2010), (1, None, 2001, 2003)])


def test_constrain_edges(spark):
    e = [(1, 1, 4, 2012, 2015, 42), (2, 3, 5, 2009, 2015, 42), (3, 1, 2, 2014, 2016, 22), (4, 5, 7, 2008, 2009, 22), (5, 4, 8, 2016, 2017, 42), (6, 4, 9, 2013, 2016, 22)]
    g = graph(spark, U1, e)
    same_e(g.constrained().edges, [e[0], (2, 3, 5, 2010, 2014, 42), e[2], e[4], (6, 4, 9, 2013, 2014, 22)])
    assert g.violations().count() > 0 and g.constrained().violations().count() == 0


def test_slice(spark):
    g = select.slice(graph(spark, U1, E1B), d(2012), d(2015))
    same_v(g.vertices, [(1, "John", 2012, 2015), (4, "Julia", 2012, 2015), (5, "Vera", 2012, 2015), (6, "Halima", 2012, 2015), (2, "Mike", 2014, 2015), (3, "Ron", 2012, 2014), (9, "Ke", 2013, 2014)])
    same_e(g.edges, [(1, 1, 4, 2012, 2015, 22), (2, 3, 5, 2012, 2013, 22), (3, 1, 2, 2014, 2015, 22), (6, 4, 9, 2013, 2014, 22)])
    outside = select.slice(graph(spark, U1, E1B), d(2001), d(2002))
    assert outside.vertices.count() == outside.edges.count() == outside.sequence().count() == 0
    empty = TemporalGraph.empty(spark)
    assert select.slice(empty, d(2001), d(2002)).sequence().count() == 0


def test_subgraphs(spark):
    g = graph(spark, U1, E1A)
    v = select.vsubgraph(g, lambda vid, attr, s, e: (vid > 3) & (attr != "Ke"))
    same_v(v.vertices, [x for x in U1 if x[0] > 3 and x[1] != "Ke"])
    same_e(v.edges, [E1A[3], E1A[4]])
    e = select.esubgraph(g, lambda c: (c["src"] > 2) & (c["attr"] == 42))
    same_v(e.vertices, U1)
    same_e(e.edges, [E1A[1], E1A[4]])
    same_e(select.esubgraph(v, lambda c: (c["src"] > 2) & (c["attr"] == 42)).edges, [E1A[4]])
    at = select.vsubgraph(g, lambda vid, attr, s, e: (s == I.date("2012-01-01")) & (e == I.date("2015-01-01")))
    same_v(at.vertices, [U1[5]])
    assert at.edges.count() == 0
    both = select.esubgraph(g, lambda c: c["src_attr"] == "John", endpoints=True)
    same_e(both.edges, [E1A[0], E1A[2]])


def test_esubgraph_sees_coalesced_edges(spark):
    v = [x for x in U1 if x[0] != 3] + [(3, "Ron", 2009, 2011), (3, "Ron", 2011, 2014)]
    e = [x for x in E1A if x[0] not in (1, 2)] + [(2, 3, 5, 2010, 2011, 42), (2, 3, 5, 2011, 2013, 42)]
    g = select.esubgraph(graph(spark, v, e), lambda c: I.overlaps(c["t_start"], c["t_end"], I.date("2011-01-01"), I.date("2012-01-01")))
    same_e(g.edges, [(2, 3, 5, 2010, 2013, 42)])
    same_v(g.vertices, U1)


def test_snapshot(spark):
    v, e = graph(spark, U1, E1A).snapshot("2012-07-01")
    assert sorted(r.vid for r in v.collect()) == [1, 3, 4, 5, 6]
    assert sorted((r.eid, r.src, r.dst) for r in e.collect()) == [(1, 1, 4), (2, 3, 5)]


def test_zoom_by_time(spark):
    g = graph(spark, U1B, [*E1A, *E2])
    three = zoom.TimeSpec(Resolution(3, "years"))
    v = [(1, "John", 2012, 2015), (3, "Ron", 2009, 2012), (4, "Julia", 2012, 2018), (5, "Vera", 2012, 2015), (6, "Halima", 2012, 2015), (2, "Mike", 2015, 2018)]
    a = zoom.temporal_zoom(g, three, Always, Always, "last", "last")
    same_v(a.vertices, v)
    same_e(a.edges, [(1, 1, 4, 2012, 2015, 42)])
    b = zoom.temporal_zoom(g, three, Always, Exists, "first", "max")
    same_v(b.vertices, v)
    same_e(b.edges, [(1, 1, 4, 2012, 2015, 42), (7, 4, 6, 2012, 2015, 22), (8, 4, 6, 2012, 2015, 72)])


def test_zoom_by_change(spark):
    g = graph(spark, U1, [*E1A, *E2B])
    one = zoom.temporal_zoom(g, zoom.ChangeSpec(1), Exists, Exists, "first", "first")
    same_v(one.vertices, U1)
    same_e(one.edges, [*E1A, *E2B])
    two = zoom.temporal_zoom(g, zoom.ChangeSpec(2), Exists, Exists, "first", "first")
    spans = {1: (2009, 2017), 2: (2013, 2018), 3: (2009, 2015), 4: (2011, 2017), 5: (2009, 2015), 6: (2011, 2015), 7: (2009, 2011), 8: (2015, 2017), 9: (2013, 2015)}
    same_v(two.vertices, [(v, a, *spans[v]) for v, a, _, _ in U1])
    spans = {1: (2011, 2015), 2: (2009, 2013), 3: (2013, 2017), 4: (2009, 2011), 5: (2015, 2017), 6: (2013, 2015), 7: (2013, 2015), 8: (2011, 2013)}
    same_e(two.edges, [(i, a, b, *spans[i], x) for i, a, b, _, _, x in [*E1A, *E2B]])
    always = zoom.temporal_zoom(g, zoom.ChangeSpec(2), Always, Exists, "first", "first")
    spans = {1: (2011, 2017), 2: (2015, 2018), 3: (2009, 2013), 4: (2013, 2017), 5: (2011, 2015), 6: (2013, 2015), 7: (2009, 2011)}
    same_v(always.vertices, [(v, a, *spans[v]) for v, a, _, _ in U1 if v in spans])
    spans = {1: (2013, 2015), 2: (2011, 2013), 3: (2015, 2017), 7: (2013, 2015)}
    same_e(always.edges, [(i, a, b, *spans[i], x) for i, a, b, _, _, x in [*E1A, *E2B] if i in spans])
    with pytest.raises(ValueError, match="window"):
        zoom.temporal_zoom(g, "2 changes", Always, Most, "first", "first")


def test_structural_zoom(spark):
    v = [(i, "abcdefg"[:i], 2009 + i, 2011 + i) for i in range(1, 8)]
    e = [(i, i, i + 1, 2010 + i, 2011 + i, 30 + 10 * i) for i in range(1, 7)]
    z = zoom.structural_zoom(graph(spark, v, e), lambda vid, attr: F.when(F.length(attr) < 5, 1).otherwise(2).cast("long"), "longest")
    same_v(z.vertices, [(1, "a", 2010, 2011), (1, "ab", 2011, 2012), (1, "abc", 2012, 2013), (1, "abcd", 2013, 2015), (2, "abcde", 2014, 2015), (2, "abcdef", 2015, 2016), (2, "abcdefg", 2016, 2018)])
    ends = {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (2, 2), 6: (2, 2)}
    same_e(z.edges, [(i, *ends[i], 2010 + i, 2011 + i, 30 + 10 * i) for i in range(1, 7)])


def test_sequence_and_span(spark):
    g = graph(spark, [(1, "a", 2010, 2017), (2, "b", 2014, 2018), (3, "c", 2009, 2014)], [(1, 1, 3, 2010, 2012, 1), (2, 1, 2, 2014, 2016, 1)])
    rows = g.sequence().orderBy("idx").collect()
    assert [r.t_start.year for r in rows] + [rows[-1].t_end.year] == [2009, 2010, 2012, 2014, 2016, 2017, 2018]
    assert tuple(g.span().first()) == (d(2009), d(2018))


def test_degree(spark):
    g = graph(spark, [(1, "a", 2010, 2017), (2, "b", 2013, 2018), (3, "c", 2009, 2014)], [(1, 1, 3, 2010, 2014, 1), (2, 1, 2, 2013, 2016, 1), (3, 1, 2, 2016, 2017, 1)])
    got = sorted((r.vid, r.t_start.year, r.t_end.year, r.degree) for r in degree(g).collect())
    assert got == [(1, 2010, 2013, 1), (1, 2013, 2014, 2), (1, 2014, 2017, 1), (2, 2013, 2017, 1), (3, 2010, 2014, 1)]
    assert {r.degree: r.n for r in degree_distribution(g).collect()} == {1: 4, 2: 1}
    loop = graph(spark, [(1, "a", 2010, 2012)], [(1, 1, 1, 2010, 2011, 1)])
    assert [r.degree for r in degree(loop).collect()] == [2]


def _ab(spark, a=A_V, b=B_V, ae=A_E, be=B_E):
    return graph(spark, a, ae), graph(spark, b, be)


def test_union_intersection_difference(spark):
    a, b = _ab(spark)
    u = setops.union(a, b, F.least, F.greatest)
    same_v(u.vertices, [(1, "a", 2010, 2014), (1, "A", 2015, 2018), (2, "b", 2010, 2014), (2, "b1", 2014, 2018), (3, "c", 2010, 2013), (3, "C", 2013, 2018), (4, "d", 2010, 2014), (5, "e", 2010, 2011), (5, "E", 2011, 2012), (5, "e", 2012, 2014)])
    same_e(u.edges, [(1, 1, 2, 2010, 2014, 42), (1, 1, 2, 2015, 2018, 22), (2, 2, 3, 2010, 2014, 42), (2, 2, 3, 2014, 2018, 52), (3, 3, 3, 2010, 2014, 42), (3, 3, 3, 2014, 2018, 22), (4, 4, 4, 2010, 2014, 52), (5, 2, 5, 2010, 2014, 42), (6, 5, 5, 2011, 2012, 22)])
    i = setops.intersection(a, b, F.least, F.least)
    same_v(i.vertices, [(3, "C", 2013, 2014), (4, "d", 2010, 2014), (5, "E", 2011, 2012)])
    m = setops.intersection(a, b, F.least, F.greatest)
    same_e(m.edges, [(3, 3, 3, 2013, 2014, 42), (4, 4, 4, 2010, 2014, 52)])
    x = setops.difference(a, b)
    same_v(x.vertices, [(1, "a", 2010, 2014), (2, "b", 2010, 2014), (3, "c", 2010, 2013), (5, "e", 2010, 2011), (5, "e", 2012, 2014)])
    same_e(x.edges, [(1, 1, 2, 2010, 2014, 42), (2, 2, 3, 2010, 2013, 42), (3, 3, 3, 2010, 2013, 42), (5, 2, 5, 2010, 2011, 42), (5, 2, 5, 2012, 2014, 42)])


def test_left_operand_comes_first(spark):
    a, b = _ab(spark, be=[*B_E[:4], (5, 5, 5, 2011, 2012, 22)])
    u = setops.union(a, b, F.concat, F.greatest)
    assert (3, "cC", d(2013), d(2014)) in vset(u.vertices) and (4, "dd1", d(2010), d(2014)) in vset(u.vertices)
    assert {(r[0], r[1], r[2]) for r in eset(u.edges)} >= {(5, 2, 5), (5, 5, 5)}
    same_v(setops.intersection(a, b, F.concat, F.greatest).vertices, [(3, "cC", 2013, 2014), (4, "dd1", 2010, 2014), (5, "eE", 2011, 2012)])


def test_difference_with_gaps(spark):
    a, b = _ab(spark, a=[(v, x, 2010, 2019) for v, x, _, _ in A_V])
    same_v(setops.difference(a, b).vertices, [(1, "a", 2010, 2015), (1, "a", 2018, 2019), (2, "b", 2010, 2014), (2, "b", 2018, 2019), (3, "c", 2010, 2013), (3, "c", 2018, 2019), (4, "d", 2014, 2019), (5, "e", 2010, 2011), (5, "e", 2012, 2019)])


def test_disjoint_and_touching(spark):
    v, e = [(1, "a", 2010, 2014), (2, "b", 2010, 2014)], [(1, 1, 2, 2010, 2014, 1)]
    a = graph(spark, v, e)
    far = graph(spark, [(2, "b", 2015, 2018), (3, "c", 2015, 2018)], [(2, 2, 3, 2015, 2018, 1)])
    near = graph(spark, [(1, "a", 2014, 2018), (2, "x", 2014, 2018)], [(1, 1, 2, 2014, 2018, 1)])
    same_v(setops.union(a, far, F.least, F.least).vertices, [*v, (2, "b", 2015, 2018), (3, "c", 2015, 2018)])
    u = setops.union(a, near, F.least, F.least)
    same_v(u.vertices, [(1, "a", 2010, 2018), (2, "b", 2010, 2014), (2, "x", 2014, 2018)])
    same_e(u.edges, [(1, 1, 2, 2010, 2018, 1)])
    for b in (far, near):
        assert setops.intersection(a, b, F.least, F.least).vertices.count() == 0
        same_v(setops.difference(a, b).vertices, v)


def test_structure_only(spark):
    true = lambda rows: [(v, True, s, e) for v, _, s, e in rows]
    flat = lambda rows: [(*x[:5], True) for x in rows]
    a, b = graph(spark, true(A_V), flat(A_E), "boolean", "boolean"), graph(spark, true(B_V), flat(B_E), "boolean", "boolean")
    u = setops.union(a, b, lambda x, y: x | y, lambda x, y: x | y)
    same_v(u.vertices, [(1, True, 2010, 2014), (1, True, 2015, 2018), (2, True, 2010, 2018), (3, True, 2010, 2018), (4, True, 2010, 2014), (5, True, 2010, 2014)])
    assert vset(setops.intersection(a, b, lambda x, y: x & y, lambda x, y: x & y).vertices) == [(3, True, d(2013), d(2014)), (4, True, d(2010), d(2014)), (5, True, d(2011), d(2012))]


def test_maps(spark):
    g = graph(spark, [(1, "B", 2010, 2014), (1, "b", 2014, 2016), (2, "c", 2010, 2014), (3, "d", 2010, 2014)], [(1, 1, 2, 2010, 2012, 4), (1, 1, 2, 2012, 2014, -4), (2, 2, 3, 2010, 2014, 2)])
    same_v(select.vmap(g, lambda vid, attr, s, e: F.upper(attr)).vertices, [(1, "B", 2010, 2016), (2, "C", 2010, 2014), (3, "D", 2010, 2014)])
    same_e(select.emap(g, lambda c: c["attr"] * c["attr"]).edges, [(1, 1, 2, 2010, 2014, 16), (2, 2, 3, 2010, 2014, 4)])


def test_components(spark):
    got = {(r.vid, r.t_start.year, r.t_end.year): r.component for r in connected_components(graph(spark, U8, [*E3, *E4A, *E4B])).collect()}
    first = dict.fromkeys(range(1, 7), 1) | {7: 7, 8: 7}
    second = {1: 1, 3: 1, 5: 1, 7: 1, 2: 2, 4: 2, 6: 2, 8: 2}
    for v in range(1, 9):
        if first[v] == second[v]:
            assert got[v, 2010, 2018] == first[v]
        else:
            assert (got[v, 2010, 2014], got[v, 2014, 2018]) == (first[v], second[v])


def test_components_of_a_long_chain(spark):
    n = 200
    g = graph(spark, [(i, "x", 2010, 2011) for i in range(n)], [(i, (i * 37) % n, ((i + 1) * 37) % n, 2010, 2011, 1) for i in range(n - 1)])
    assert {r.component for r in connected_components(g).collect()} == {0}


def test_paths(spark):
    g = graph(spark, U8, [*E3, *E4A])
    got = {(r.vid, r.t_start.year): r.distances for r in shortest_paths(g, [1, 2], directed=False).collect()}
    assert [got[v, 2010] for v in range(1, 8)] == [{1: 0, 2: 1}, {1: 1, 2: 0}, {1: 2, 2: 1}, {1: 2, 2: 1}, {1: 3, 2: 2}, {1: 2, 2: 1}, {}]
    assert [got[v, 2014] for v in range(1, 8)] == [{1: 0}, {2: 0}, {1: 1}, {2: 1}, {1: 1}, {2: 1}, {1: 2}]
    assert got[8, 2010] == {}
    got = {(r.vid, r.t_start.year): r.distances for r in shortest_paths(g, [5, 6]).collect()}
    assert [got[v, 2010] for v in range(1, 9)] == [{5: 3, 6: 2}, {5: 2, 6: 1}, {5: 1, 6: 2}, {5: 1, 6: 2}, {5: 0, 6: 1}, {6: 0}, {}, {}]
    assert [got[v, 2014] for v in range(1, 6)] == [{5: 1}, {6: 1}, {}, {}, {5: 0}]


def test_paths_and_components_beyond_the_caps_of_their_sql(spark):
    """A chain of 20 hops, and 45 snapshots with edges in all of them: no distance over 12 and no snapshot from 40 on is lost."""
    n, years = 21, 45
    chain = [(i, i, i + 1, 2000, 2000 + years, 1) for i in range(n - 1)]
    extra = [(1000 + y, n, n + 1, 2000 + y, 2001 + y, y) for y in range(years)]
    g = graph(spark, [(i, "x", 2000, 2000 + years) for i in range(n + 2)], [*chain, *extra])
    assert g.sequence().count() == years
    for directed in (True, False):
        got = [(r.vid, r.t_start.year, r.t_end.year, r.distances) for r in shortest_paths(g, [n - 1], directed).collect()]
        assert {(v, tuple(d.items())) for v, _, _, d in got if v < n} == {(v, ((n - 1, n - 1 - v),)) for v in range(n)}
        assert all(sum(e - s for x, s, e, _ in got if x == v) == years for v in range(n))
    found = [(r.vid, r.t_start.year, r.t_end.year, r.component) for r in connected_components(g).collect()]
    assert {(v, c) for v, _, _, c in found} == {(v, 0) for v in range(n)} | {(n, n), (n + 1, n)}
    assert all(sum(e - s for x, s, e, _ in found if x == v) == years for v in range(n + 2))


@pytest.mark.parametrize("directed", [True, False])
def test_pagerank(spark, directed):
    g = graph(spark, U8, [*E3, *E4A, *E4B])
    s = snapshots(g)
    all_edges, n = s.e.collect(), s.sequence.count()
    got = {(r.vid, y): r["rank"] for r in pagerank(g, tol=0.001, iterations=10, directed=directed).collect() for y in range(r.t_start.year, r.t_end.year)}
    years = [r.t_start.year for r in s.sequence.orderBy("idx").collect()]
    for t in range(n):
        arcs = [(e.src, e.dst) for e in all_edges if e.t == t]
        arcs += [] if directed else [(b, a) for a, b in arcs]
        out = {v: sum(a == v for a, _ in arcs) for v in range(1, 9)}
        rank = dict.fromkeys(out, 0.15)
        for _ in range(10):
            rank = {v: 0.15 + 0.85 * sum(rank[a] / out[a] for a, b in arcs if b == v) for v in rank}
        for v, r in rank.items():
            assert got[v, years[t]] == pytest.approx(r, abs=1e-2 if not directed else 1e-3)


def test_triangles_and_clustering(spark):
    g = graph(spark, U8, [*E3, *E4A, (20, 2, 3, 2010, 2014, 1)])
    got = {(r.vid, r.t_start.year): r.triangles for r in triangle_count(g).collect()}
    assert {k: n for k, n in got.items() if n} == {(2, 2010): 1, (3, 2010): 2, (4, 2010): 2, (5, 2010): 1}
    plain = graph(spark, U8, [*E3, *E4A])
    got = {(r.vid, r.t_start.year): r.ccoeff for r in clustering_coefficient(plain).collect() if r.ccoeff}
    assert got == {(2, 2010): pytest.approx(1 / 12), (3, 2010): pytest.approx(2 / 6), (4, 2010): pytest.approx(2 / 6), (5, 2010): pytest.approx(1 / 6)}


def test_messages(spark):
    v = [(1, "John", 2010, 2016), (2, "Mike", 2010, 2016), (3, "Ron", 2010, 2014)]
    e = [(1, 1, 2, 2010, 2014, "friend"), (2, 2, 1, 2012, 2016, "enemy"), (3, 3, 2, 2010, 2014, "friend")]
    g = graph(spark, v, e, e_kind="string")
    one = F.lit(1)
    count = lambda m: F.count(m)
    zero = F.lit(0).cast("long")
    periods = lambda df: sorted((r.vid, r.t_start.year, r.t_end.year, r.agg) for r in df.collect())
    both = messages.aggregate_messages(g, lambda c: {"src": one, "dst": one}, count, zero)
    assert periods(both) == [(1, 2010, 2012, 1), (1, 2012, 2014, 2), (1, 2014, 2016, 1), (2, 2010, 2012, 2), (2, 2012, 2014, 3), (2, 2014, 2016, 1), (3, 2010, 2014, 1)]
    friends = messages.aggregate_messages(g, lambda c: {"dst": F.when(c["attr"] == "friend", 1)}, count, zero)
    assert periods(friends) == [(1, 2010, 2016, 0), (2, 2010, 2014, 2), (2, 2014, 2016, 0), (3, 2010, 2014, 0)]
    john = messages.aggregate_messages(g, lambda c: {"dst": F.when(c["src_attr"] == "John", 1)}, count, zero, endpoints=True)
    assert periods(john) == [(1, 2010, 2016, 0), (2, 2010, 2014, 1), (2, 2014, 2016, 0), (3, 2010, 2014, 0)]
    with pytest.raises(ValueError, match="src or dst"):
        messages.aggregate_messages(g, lambda c: {"elsewhere": one}, count, zero)


def test_pregel_reaches_a_fixed_point(spark):
    g = graph(spark, U8, [*E3, *E4A])
    send = lambda c: {"dst": F.when(c["src_value"] < c["dst_value"], c["src_value"]), "src": F.when(c["dst_value"] < c["src_value"], c["dst_value"])}
    out = messages.pregel(g, F.lit(10**9), 50, lambda vid, value, m: F.least(value, m), send, F.min, start=lambda vid, attr: vid)
    least = {(r.vid, r.t_start, r.t_end): r.value for r in out.collect()}
    assert least == {(r.vid, r.t_start, r.t_end): r.component for r in connected_components(g).collect()}


def test_fold_goes_by_start(spark):
    df = vertices(spark, [(1, "b", 2012, 2014), (1, "a", 2010, 2013), (1, "c", 2013, 2014)])
    whole = df.groupBy("vid").agg(fold(F.concat)(F.col("attr"), F.col("t_start")).alias("x")).first().x
    assert whole == "abc"


def test_from_positions(spark):
    v = spark.createDataFrame([(1, 0, 86400 * 3, "x")], "id long, a long, b long, name string")
    e = spark.createDataFrame([(9, 1, 1, 86400, 2 * 86400)], "e long, s long, d long, a long, b long")
    g = TemporalGraph.from_positions(v, e)
    same_v(g.vertices, [(1, "x", "1970-01-01", "1970-01-04")])
    same_e(g.edges, [(9, 1, 1, "1970-01-02", "1970-01-03", True)])
    assert edges(spark, []).count() == 0


def test_subtract_takes_away_all_of_a_list(spark):
    a = vertices(spark, [(1, "x", 2000, 2020), (1, "y", 2005, 2010), (2, "x", 2000, 2001), (3, "x", 2000, 2010)])
    b = vertices(spark, [(1, "", 2003, 2006), (1, "", 2004, 2007), (1, "", 2012, 2013), (3, "", 1990, 2030), (9, "", 2000, 2020)])
    same_v(normalize.subtract(a, b, ["vid"]), [(1, "x", 2000, 2003), (1, "x", 2007, 2012), (1, "x", 2013, 2020), (1, "y", 2007, 2010), (2, "x", 2000, 2001)])
    same_v(normalize.subtract(a, b.limit(0), ["vid"]), [(1, "x", 2000, 2020), (1, "y", 2005, 2010), (2, "x", 2000, 2001), (3, "x", 2000, 2010)])


def test_a_long_edge_among_many_changes_stays_one_row(spark, tmp_path, monkeypatch):
    """One edge over 1200 days, beside an edge a day between others: no table of an analytic has a row a day for it."""
    from chronoweave.plans import storage

    days = 1200
    first = d(2000)
    day = lambda i: first + timedelta(i)
    daily = [(100 + i, 3, 4, day(i), day(i + 1), i) for i in range(days)]
    g = graph(spark, [(i, "x", first, day(days)) for i in (1, 2, 3, 4)], [(1, 1, 2, first, day(days), 0), *daily])
    tables = []

    def noted(session, name):
        tables.append(f"file://{tmp_path}/{name}-{len(tables)}")
        return tables[-1]

    monkeypatch.setattr(storage, "fresh_path", noted)
    assert g.sequence().count() == days
    found = [connected_components(g), shortest_paths(g, [2]), pagerank(g, tol=0.0, iterations=3), triangle_count(g)]
    found.append(messages.pregel(g, F.lit(-1).cast("long"), 2, lambda vid, value, m: F.greatest(value, m), lambda c: {"dst": c["src_value"]}, F.max, start=lambda vid, attr: vid))
    assert [df.where("vid <= 2").count() for df in found] == [2] * len(found)
    assert len(tables) > 10
    for path in tables:
        df = spark.read.parquet(path)
        ends = [c for c in ("vid", "x", "a", "src", "__v") if c in df.columns]
        assert df.where(F.col(ends[0]) <= 2).count() < 20, path


def test_structural_zoom_of_one_group_with_all_vertices(spark):
    """Members of equal period become one before they are cut."""
    n, years = 3000, 10
    df = spark.range(n).selectExpr("id AS vid", "make_date(int(2000 + id % 10), 1, 1) AS t_start", "make_date(int(2001 + id % 10 + id % 3), 1, 1) AS t_end", "id AS attr")
    g = TemporalGraph.of(df, edges(spark, []), coalesced=True)
    rows = {(r.t_start.year, r.t_end.year): r.attr for r in zoom.structural_zoom(g, lambda vid, attr: F.lit(7).cast("long"), "sum").vertices.collect()}
    assert rows == {(2000 + y, 2001 + y): sum(i for i in range(n) if i % 10 <= y < i % 10 + 1 + i % 3) for y in range(years)} | {(2010, 2011): sum(i for i in range(n) if i % 10 + i % 3 >= 10), (2011, 2012): sum(i for i in range(n) if i % 10 + i % 3 >= 11)}
    small = normalize.merged_aggregate(df.selectExpr("7 AS g", "t_start", "t_end", "attr"), ["g"], F.max("attr"), F.max("attr"))
    assert small.where("t_start = date'2005-01-01'").first().attr == max(i for i in range(n) if i % 10 <= 5 < i % 10 + 1 + i % 3)


def test_times_survive_any_session_zone(spark, tmp_path):
    from chronoweave.sources.graphs import load_graph, save_graph

    g = graph(spark, [(1, "x", "2024-01-10", "2024-01-20"), (2, "x", "1950-03-31", "2024-10-27")], [])
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("Europe/Berlin", "America/New_York", "Pacific/Kiritimati", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            path = f"{tmp_path}/{zone.replace('/', '-')}"
            save_graph(g, path)
            same_v(load_graph(spark, path, "attr").vertices, [(1, "x", "2024-01-10", "2024-01-20"), (2, "x", "1950-03-31", "2024-10-27")])
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)

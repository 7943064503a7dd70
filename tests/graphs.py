"""Small graphs and comparison of results. A bare year is its first of January; intervals are closed-open."""

from datetime import date

from chronoweave.plans.graph import TemporalGraph


def d(x):
    return x if isinstance(x, date) else date(x, 1, 1) if isinstance(x, int) else date.fromisoformat(x)


def vertices(spark, rows, kind="string"):
    return spark.createDataFrame([(v, d(s), d(e), a) for v, a, s, e in rows], f"vid long, t_start date, t_end date, attr {kind}")


def edges(spark, rows, kind="int"):
    return spark.createDataFrame([(i, a, b, d(s), d(e), x) for i, a, b, s, e, x in rows], f"eid long, src long, dst long, t_start date, t_end date, attr {kind}")


def graph(spark, v, e, v_kind="string", e_kind="int"):
    return TemporalGraph.of(vertices(spark, v, v_kind), edges(spark, e, e_kind))


def vset(df):
    return sorted(((r.vid, r.attr, r.t_start, r.t_end) for r in df.collect()), key=str)


def eset(df):
    return sorted(((r.eid, r.src, r.dst, r.t_start, r.t_end, r.attr) for r in df.collect()), key=str)


def same_v(df, rows):
    assert vset(df) == sorted(((v, a, d(s), d(e)) for v, a, s, e in rows), key=str)


def same_e(df, rows):
    assert eset(df) == sorted(((i, a, b, d(s), d(e), x) for i, a, b, s, e, x in rows), key=str)


U1 = [(1, "John", 2010, 2017), (2, "Mike", 2014, 2018), (3, "Ron", 2009, 2014), (4, "Julia", 2012, 2017), (5, "Vera", 2010, 2015), (6, "Halima", 2012, 2015), (7, "Sanjana", 2009, 2011), (8, "Lovro", 2016, 2017), (9, "Ke", 2013, 2014)]
U1B = [x if x[0] != 4 else (4, "Julia", 2012, 2018) for x in U1]
E1A = [(1, 1, 4, 2012, 2015, 42), (2, 3, 5, 2010, 2013, 42), (3, 1, 2, 2014, 2016, 22), (4, 5, 7, 2010, 2011, 22), (5, 4, 8, 2016, 2017, 42), (6, 4, 9, 2013, 2014, 22)]
E1B = [(*x[:5], 22) for x in E1A]
E2 = [(7, 4, 6, 2013, 2015, 22), (8, 4, 6, "2012-06-01", 2013, 72)]
E2B = [(7, 4, 6, 2013, 2015, 22), (8, 4, 6, 2012, 2013, 72)]
U8 = [(i + 1, n, 2010, 2018) for i, n in enumerate(("John", "Mike", "Ron", "Julia", "Vera", "Halima", "Sanjana", "Lovro"))]
E3 = [(1, 1, 2, 2010, 2014, 42), (2, 2, 3, 2010, 2014, 42), (3, 2, 6, 2010, 2018, 42), (4, 2, 4, 2010, 2018, 42), (5, 3, 5, 2010, 2014, 42), (6, 3, 4, 2010, 2014, 42), (7, 4, 5, 2010, 2014, 42), (8, 5, 6, 2010, 2014, 42), (9, 7, 8, 2010, 2014, 42)]
E4A = [(10, 1, 3, 2014, 2018, 42), (11, 1, 5, 2014, 2018, 42), (12, 3, 7, 2014, 2018, 42), (13, 5, 7, 2014, 2018, 42)]
E4B = [(14, 4, 8, 2014, 2018, 42), (15, 6, 8, 2014, 2018, 42)]
A_V = [(1, "a", 2010, 2014), (2, "b", 2010, 2014), (3, "c", 2010, 2014), (4, "d", 2010, 2014), (5, "e", 2010, 2014)]
A_E = [(1, 1, 2, 2010, 2014, 42), (2, 2, 3, 2010, 2014, 42), (3, 3, 3, 2010, 2014, 42), (4, 4, 4, 2010, 2014, 42), (5, 2, 5, 2010, 2014, 42)]
B_V = [(1, "A", 2015, 2018), (2, "b1", 2014, 2018), (3, "C", 2013, 2018), (4, "d1", 2010, 2014), (5, "E", 2011, 2012)]
B_E = [(1, 1, 2, 2015, 2018, 22), (2, 2, 3, 2014, 2018, 52), (3, 3, 3, 2013, 2018, 22), (4, 4, 4, 2010, 2014, 52), (6, 5, 5, 2011, 2012, 22)]

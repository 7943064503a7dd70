"""What must hold at every instant: an operator's snapshot is the plain operator on the snapshot."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import select, setops, zoom
from chronoweave.plans import normalize
from chronoweave.plans.graph import TemporalGraph

DAY0 = date(2020, 1, 1)


def at(n):
    return DAY0 + timedelta(n)


def make(spark, seed):
    r = random.Random(seed)

    def interval():
        s = r.randrange(25)
        return at(s), at(s + 1 + r.randrange(10))

    v = spark.createDataFrame([(r.randrange(6), *interval(), r.choice("ab")) for _ in range(18)], "vid long, t_start date, t_end date, attr string")
    v = normalize.islands(v, ["vid"]).withColumn("attr", F.when(F.dayofmonth("t_start") % 2 == 0, "a").otherwise("b"))
    pairs = [(r.randrange(6), r.randrange(6)) for _ in range(25)]
    e = spark.createDataFrame([(a * 10 + b, a, b, *interval(), 1) for a, b in pairs], "eid long, src long, dst long, t_start date, t_end date, attr int")
    e = normalize.islands(e, ["eid", "src", "dst"]).withColumn("attr", F.month("t_end"))
    return TemporalGraph.of(v, e).constrained()


def days(g):
    """Per day: the vertices with attributes and the edges with attributes."""
    v, e = {}, {}
    for r in g.vertices.collect():
        for n in range((r.t_end - r.t_start).days):
            assert v.setdefault(r.t_start + timedelta(n), {}).setdefault(r.vid, r.attr) == r.attr, "two values at a time"
    for n, r in ((n, r) for r in g.edges.collect() for n in range((r.t_end - r.t_start).days)):
        assert e.setdefault(r.t_start + timedelta(n), {}).setdefault((r.eid, r.src, r.dst), r.attr) == r.attr
    return [(v.get(at(n), {}), e.get(at(n), {})) for n in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_reducibility(spark, seed):
    a, b = make(spark, seed).coalesced().persist(), make(spark, seed + 100).coalesced().persist()
    da, db = days(a), days(b)
    f = lambda x, y: F.concat(x, y)
    u, i, m = (days(g) for g in (setops.union(a, b, f, lambda x, y: x + y), setops.intersection(a, b, f, lambda x, y: x + y), setops.difference(a, b)))
    sub = days(select.vsubgraph(a, lambda vid, attr, s, e: attr == "a"))
    group = days(zoom.structural_zoom(a, lambda vid, attr: vid % 2, "max"))
    for n in range(60):
        (va, ea), (vb, eb) = da[n], db[n]
        join = lambda x, y: {k: (x[k] + y[k] if k in x and k in y else x.get(k, y.get(k))) for k in x | y}
        assert u[n] == (join(va, vb), join(ea, eb))
        assert i[n] == ({k: va[k] + vb[k] for k in va.keys() & vb.keys()}, {k: ea[k] + eb[k] for k in ea.keys() & eb.keys()})
        left = {k: x for k, x in va.items() if k not in vb}
        assert m[n] == (left, {k: x for k, x in ea.items() if k not in eb and k[1] in left and k[2] in left})
        keep = {k: x for k, x in va.items() if x == "a"}
        assert sub[n] == (keep, {k: x for k, x in ea.items() if k[1] in keep and k[2] in keep})
        assert group[n][0] == {k: max(x for v, x in va.items() if v % 2 == k) for k in {v % 2 for v in va}}
        assert group[n][1] == {(k[0], k[1] % 2, k[2] % 2): x for k, x in ea.items()}


def test_coalesce_is_idempotent_and_integrity_holds(spark):
    a, b = make(spark, 7), make(spark, 8)
    once = a.vertices
    assert sorted(map(str, normalize.coalesce(once, ["vid"]).collect())) == sorted(map(str, once.collect()))
    for g in (setops.union(a, b, F.least, F.least), setops.difference(a, b), setops.intersection(a, b, F.least, F.least)):
        assert g.violations().count() == 0
    none = setops.intersection(setops.difference(a, b), b, F.least, F.least)
    assert none.vertices.count() == 0

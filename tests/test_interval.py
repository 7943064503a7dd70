"""Intervals, resolutions, quantifiers and series."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import interval as I  # noqa: N812
from chronoweave.functions.quantify import Always, AtLeast, Exists, Most
from chronoweave.functions.resolution import Resolution, split
from chronoweave.functions.series import linear_trend, make_series, slope

from .graphs import d


def row(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_predicates(spark):
    def check(f, *dates):
        return row(spark, f(*[F.lit(d(x)) for x in dates]))[0]

    assert check(I.contains, 2010, 2014, 2011, 2014) and not check(I.contains, 2010, 2014, 2009, 2012)
    assert check(I.contains_date, 2010, 2014, 2010) and not check(I.contains_date, 2010, 2014, 2014)
    assert check(I.overlaps, 2010, 2014, 2013, 2015) and not check(I.overlaps, 2010, 2014, 2014, 2015)
    assert check(I.touches, 2010, 2014, 2014, 2015) and not check(I.touches, 2010, 2014, 2013, 2015)
    assert check(I.is_empty, 2010, 2010)
    assert check(I.ratio, 2010, 2010, 2010, 2010) == 1.0
    assert check(I.ratio, 2010, 2011, 2009, 2013) == pytest.approx(365 / 1461)
    assert check(I.as_text, 2010, 2011) == "[2010-01-01-2011-01-01)"
    assert check(I.interval_or_null, 2011, 2011) is None


@pytest.mark.parametrize(("gone", "left"), [((2011, 2012), [(2010, 2011), (2012, 2014)]), ((2009, 2012), [(2012, 2014)]), ((2009, 2015), []), ((2015, 2016), [(2010, 2014)]), ((2013, 2020), [(2010, 2013)])])
def test_difference(spark, gone, left):
    got = row(spark, I.difference(*[F.lit(d(x)) for x in (2010, 2014, *gone)]))[0]
    assert [(r.t_start.year, r.t_end.year) for r in got] == left
    assert [(a.year, b.year) for a, b in I.difference_list((d(2010), d(2014)), [(d(gone[0]), d(gone[1]))])] == left


def test_lists_and_names():
    x = [(d(2012), d(2013)), (d(2010), d(2011)), (d(2011), d(2012)), (d(2015), d(2016))]
    assert I.coalesced(x) == [(d(2010), d(2013)), (d(2015), d(2016))]
    assert I.difference_list((d(2009), d(2017)), x) == [(d(2009), d(2010)), (d(2013), d(2015)), (d(2016), d(2017))]
    assert I.difference_list((d(2009), d(2010)), []) == [(d(2009), d(2010))]
    assert I.parse("nodes_t_3_2010-01-01-2012-02-03") == (date(2010, 1, 1), date(2012, 2, 3))
    with pytest.raises(ValueError):
        I.parse("nodes")
    with pytest.raises(ValueError):
        I.checked(d(2011), d(2010))


def pieces(spark, s, e, resolution, mark):
    got = row(spark, split(F.lit(d(s)), F.lit(d(e)), resolution, F.lit(d(mark))))[0]
    return [tuple(map(str, r)) for r in got]


def test_split_by_months_and_years(spark):
    got = pieces(spark, "2011-06-16", "2012-04-10", Resolution(1, "months"), "2011-06-01")
    assert len(got) == 11
    assert got[0] == ("2012-04-01", "2012-04-10", "2012-04-01", "2012-05-01")
    assert got[-1] == ("2011-06-16", "2011-07-01", "2011-06-01", "2011-07-01")
    got = pieces(spark, "2011-06-16", "2013-04-10", Resolution(1, "years"), "2011-06-01")
    assert got == [("2013-01-01", "2013-04-10", "2013-01-01", "2014-01-01"), ("2012-01-01", "2013-01-01", "2012-01-01", "2013-01-01"), ("2011-06-16", "2012-01-01", "2011-01-01", "2012-01-01")]


def test_split_by_days(spark):
    got = pieces(spark, "2011-06-02", "2011-06-11", Resolution(3), "2011-06-01")
    assert got == [("2011-06-10", "2011-06-11", "2011-06-10", "2011-06-13"), ("2011-06-07", "2011-06-10", "2011-06-07", "2011-06-10"), ("2011-06-04", "2011-06-07", "2011-06-04", "2011-06-07"), ("2011-06-02", "2011-06-04", "2011-06-01", "2011-06-04")]
    with pytest.raises(Exception, match="mark is after"):
        pieces(spark, "2011-06-02", "2011-06-11", Resolution(3), "2011-07-01")


def test_resolutions():
    month, quarter, year = Resolution(1, "months"), Resolution(3, "months"), Resolution(1, "years")
    assert Resolution.parse("P1W") == Resolution(7) and Resolution.parse("P3M") == quarter
    for bad in ("P1Y2M", "3M", "P"):
        with pytest.raises(ValueError):
            Resolution.parse(bad)
    with pytest.raises(ValueError):
        Resolution(0, "days")
    assert month.window(date(2012, 2, 29)) == (date(2012, 2, 1), date(2012, 3, 1))
    assert year.window(date(2012, 2, 29)) == (d(2012), d(2013))
    assert quarter.minus(date(2012, 2, 10)) == date(2011, 11, 1)
    assert quarter.nth(date(2012, 2, 10), 2) == (date(2012, 8, 10), date(2012, 11, 10))
    assert month.nth(date(2012, 1, 31), 1) == (date(2012, 2, 29), date(2012, 3, 31))
    assert month.number_between(d(2012), d(2014)) == 24
    assert Resolution(1).parts(month, date(2012, 2, 3)) == 29 and month.parts(year, d(2012)) == 12
    assert quarter.compatible(year) and not Resolution(2).compatible(year) and not Resolution(5, "months").compatible(year)
    assert year.greater(month) and month.greater(Resolution(7))
    assert Resolution.between(d(2012), d(2014)) == Resolution(2, "years") and Resolution.between(d(2012), date(2012, 1, 9)) == Resolution(8)


def test_quantifiers():
    assert Always.keeps(1.0) and not Always.keeps(0.99)
    assert Exists.keeps(0.001) and not Exists.keeps(0.0)
    assert Most.keeps(0.51) and not Most.keeps(0.5)
    assert AtLeast(0.5).keeps(0.5) and not AtLeast(0.5).keeps(0.49)


def test_series(spark):
    v = spark.createDataFrame([(1, d("2012-01-01"), d("2012-01-03"), 2), (1, d("2012-01-03"), d("2012-01-05"), 4), (1, d("2012-01-08"), d("2012-01-09"), 7)], "k int, t_start date, t_end date, value int")
    got = {r.i: r.value for r in make_series(v, ["k"], Resolution(1), F.lit(-1)).collect()}
    assert got == {0: 2, 1: 2, 2: 4, 3: 4, 4: 4, 5: -1, 6: -1, 7: 7, 8: 7}
    assert linear_trend(v.where("value < 5"), ["k"], Resolution(1)).first().slope == 0.6
    points = spark.createDataFrame([(1, x, 2.0 * x + 1) for x in range(5)], "k int, x int, y double")
    assert slope(points, ["k"], "x", "y").first().slope == 2.0


def test_property_bags(spark):
    from chronoweave.functions import properties as P  # noqa: N812

    a, b = P.bag(name="x", kind="k"), P.bag(kind="l", more="m")
    r = row(spark, P.size(a), P.exists(a, "name"), P.exists(a, "more"), P.get(a, "kind"), P.get(a, "none"), P.names(P.drop(a, "name")), P.merged(a, b), P.put(a, "name", F.lit("y")), P.size(P.bag()))
    assert tuple(r) == (2, True, False, "k", None, ["kind"], {"name": "x", "kind": "l", "more": "m"}, {"name": "y", "kind": "k"}, 0)

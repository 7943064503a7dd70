"""Tasks follow the bytes of the input's files, not only the session's number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.interval import sort_key
from chronoweave.operators import pagerank
from chronoweave.plans import normalize
from chronoweave.queries import QUERIES

from .graphs import d, graph, same_e, same_v

SF = "/root/testdata/sf0.01"


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(normalize, "TASK_BYTES", 1 << 16, raising=False)


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_constrain_edges_deals_its_input_by_size(spark, small_tasks):
    assert tasks(QUERIES["constrain_edges"](spark, SF)) > 8  # the session has 4 partitions


def test_tasks_are_counted_from_each_file_once(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    one = normalize.tasks_for(lines)
    assert normalize.tasks_for(lines, lines.select("l_orderkey").union(lines.select("l_suppkey"))) == one
    assert normalize.tasks_for(spark.range(5)) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["interval_difference", "interval_intersect", "interval_union"])
def test_sequences_deal_their_relations_by_size(spark, small_tasks, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(dst" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)


@pytest.mark.parametrize("name", ["interval_difference", "interval_intersect", "interval_union"])
def test_sequences_compute_their_relations_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1 and "NestedLoopJoin" not in plan


def test_sequences_of_spans_that_differ_or_are_missing(spark):
    def relation(rows):
        return spark.createDataFrame([(d(s), d(e)) for s, e in rows], "t_start date, t_end date")

    def years(df):
        return sorted((r.t_start.year, r.t_end.year) for r in df.collect())

    a, b, none = relation([(2010, 2012), (2011, 2015)]), relation([(2013, 2014), (2013, 2018), (2019, 2020)]), relation([])
    assert years(normalize.interval_union(a, b)) == [(2010, 2011), (2011, 2012), (2012, 2013), (2013, 2014), (2014, 2015), (2015, 2018), (2018, 2019), (2019, 2020)]
    assert years(normalize.interval_intersect(a, b)) == years(normalize.interval_intersect(b, a)) == [(2013, 2014), (2014, 2015)]
    assert years(normalize.interval_difference(a, b)) == [(2010, 2011), (2011, 2012), (2012, 2013), (2013, 2014), (2014, 2015)]
    assert years(normalize.interval_intersect(a, relation([(2020, 2021)]))) == years(normalize.interval_difference(none, a)) == []
    assert years(normalize.interval_intersect(a, none)) == years(normalize.interval_difference(a, none)) == [(2010, 2011), (2011, 2012), (2012, 2015)]  # as in the SQL, a missing span is no bound


@pytest.mark.parametrize("name", ["zoom_year_e", "zoom_quarter_e"])
def test_zooms_deal_their_edges_by_size(spark, small_tasks, name):
    assert tasks(QUERIES[name](spark, SF)) > 8


def test_places_in_an_order_are_given_by_many_tasks(spark, small_tasks):
    df = QUERIES["interval_order"](spark, SF)
    assert tasks(df) > 1
    rows = df.orderBy(sort_key(F.col("t_start"), F.col("t_end")), "vid").collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))


def test_sums_over_time_compute_their_tuples_once(spark, tmp_path):
    rows = [(1, 2010, 2013, 0.1), (1, 2011, 2013, 0.2), (1, 2015, 2016, 0.3), (1, 2016, 2017, 0.3), (2, 2010, 2010, 0.5)]
    spark.createDataFrame([(v, d(s), d(e), x) for v, s, e, x in rows], "vid long, t_start date, t_end date, x double").write.parquet(f"{tmp_path}/t")
    out = normalize.summed(spark.read.parquet(f"{tmp_path}/t"), ["vid"], "x")
    got = sorted((r.vid, r.t_start.year, r.t_end.year, round(r.x, 9)) for r in out.collect())
    assert got == [(1, 2010, 2011, 0.1), (1, 2011, 2013, 0.3), (1, 2015, 2017, 0.3)]
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["pagerank_directed", "pagerank_undirected", "pagerank_tolerance"])
def test_ranks_compute_their_graph_once(spark, monkeypatch, name):
    graphs, ranked = [], pagerank.pagerank
    monkeypatch.setattr(pagerank, "pagerank", lambda g, **how: graphs.append(g) or ranked(g, **how))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    (g,) = graphs
    assert not [f for df in (g.vertices, g.edges, out) for f in df.inputFiles() if f.endswith("events.parquet")]


def test_a_stored_graph_is_the_coalesced_one(spark):
    g = graph(spark, [(1, "a", 2010, 2012), (1, "a", 2012, 2014), (2, "b", 2010, 2014)], [(7, 1, 2, 2010, 2011, 3), (7, 1, 2, 2011, 2013, 3)])
    stored = g.stored()
    same_v(stored.vertices, [(1, "a", 2010, 2014), (2, "b", 2010, 2014)])
    same_e(stored.edges, [(7, 1, 2, 2010, 2013, 3)])
    assert stored.vertices is stored.vertex_tuples and stored.edges is stored.edge_tuples

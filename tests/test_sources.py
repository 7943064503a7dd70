"""Files in and out, point queries, partition strategies."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.resolution import Resolution
from chronoweave.operators import partition
from chronoweave.operators.degree import degree_distribution
from chronoweave.sources import graphs, text

from .graphs import E1A, U1, d, graph, same_e, same_v


def test_save_and_load(spark, tmp_path):
    g = graph(spark, U1, E1A)
    graphs.save_graph(g, str(tmp_path))
    back = graphs.load_graph(spark, str(tmp_path), "attr", 1)
    same_v(back.vertices, U1)
    same_e(back.edges, E1A)
    bare = graphs.load_graph(spark, str(tmp_path))
    assert {r.attr for r in bare.vertices.collect()} == {True}
    with pytest.raises(ValueError, match="attributes"):
        graphs.load_graph(spark, str(tmp_path), 3)
    assert {r.attr for r in graphs.load_graph(spark, str(tmp_path), 1, 7).edges.collect()} == {True}


def test_bounds_prune_directories_and_clip(spark, tmp_path):
    g = graph(spark, U1, E1A)
    graphs.save_graph(g, str(tmp_path), "t", "5", (d(2005), d(2020)))
    graphs.save_graph(g, str(tmp_path), "t", "5", (d(2030), d(2031)))
    assert len(graphs.group_paths(spark, str(tmp_path), "nodes", "t", "5")) == 2
    assert len(graphs.group_paths(spark, str(tmp_path), "nodes", "t", "5", (d(2012), d(2015)))) == 1
    got = graphs.load_graph(spark, str(tmp_path), 1, 1, (d(2012), d(2015)), "t", "5")
    same_e(got.edges, [(1, 1, 4, 2012, 2015, 42), (2, 3, 5, 2012, 2013, 42), (3, 1, 2, 2014, 2015, 22), (6, 4, 9, 2013, 2014, 22)])
    assert graphs.load_graph(spark, str(tmp_path), 1, 1, (d(2025), d(2026)), "t", "5").vertices.count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    graphs.save_graph(graph(spark, U1, E1A), str(tmp_path))
    g = graphs.load_graph(spark, str(tmp_path), None, None, (d(2012), d(2015)))
    plan = g.vertex_tuples._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(eend" in plan and "LessThan(estart" in plan and "attr" not in plan.split("ReadSchema")[1]


def test_points_and_histories(spark):
    g = graph(spark, U1, E1A)
    assert graphs.node_at(g, 3, "2013-12-31").first().attr == "Ron" and graphs.node_at(g, 3, "2014-01-01").count() == 0
    assert graphs.edge_at(g, 2, "2010-01-01").first().attr == 42
    (r,) = graphs.node_history(g, 3, "2010-01-01", "2011-01-01").collect()
    assert (r.t_start, r.t_end) == (d(2009), d(2014))
    assert graphs.edge_history(g, 2, "2013-01-01", "2014-01-01").count() == 0


def test_edge_lists(spark, tmp_path):
    (tmp_path / "edges2012-01-01.txt").write_text("# comment\n3 1\n\n2 5 7\n")
    (tmp_path / "edges2012-03-01.txt").write_text("1\t2 9\n")
    got = sorted((r.src, r.dst, r.attr) for r in text.edge_list(spark, str(tmp_path / "*.txt")).collect())
    assert got == [(1, 2, 9), (2, 5, 7), (3, 1, 1)]
    paths = [str(tmp_path / "edges2012-01-01.txt"), str(tmp_path / "edges2012-03-01.txt")]
    dated = text.dated_edge_lists(spark, paths, d(2012), Resolution(1, "months"), canonical=True)
    assert sorted((r.src, r.dst, r.t) for r in dated.collect()) == [(1, 2, 2), (1, 3, 0), (2, 5, 0)]
    (tmp_path / "bad.txt").write_text("1\n")
    with pytest.raises(Exception, match="not an edge"):
        text.edge_list(spark, str(tmp_path / "bad.txt")).collect()
    assert text.monthly_paths("r", "nodes", date(2011, 12, 5), date(2012, 1, 1)) == ["r/nodes2011-12-01.txt", "r/nodes2012-01-01.txt"]
    assert text.in_range(["a2011-01-01", "b2012-01-01", "c"], d(2012), d(2013)) == ["b2012-01-01"]
    (tmp_path / "nodes").write_text("1 John Smith\n2\n")
    assert sorted(map(tuple, text.node_list(spark, str(tmp_path / "nodes")).collect())) == [(1, "John Smith"), (2, "")]


def test_degree_distribution_file(spark, tmp_path):
    text.write_degree_distribution(degree_distribution(graph(spark, U1, E1A)), str(tmp_path / "d"))
    lines = [r.value.split() for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert lines == sorted(lines, key=lambda x: int(x[0])) and all(len(x) == 2 for x in lines)


@pytest.mark.parametrize("strategy", partition.STRATEGIES)
@pytest.mark.parametrize(("n", "runs"), [(1, 1), (4, 2), (40, 3)])
def test_partitions(spark, strategy, n, runs):
    e = spark.range(600).selectExpr("id AS eid", "id % 17 AS src", "id % 23 AS dst", "CAST(id % 12 AS INT) AS t")
    rows = partition.partition_by(e, strategy, n, 12, runs).withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == 600 and {r.part for r in rows} <= set(range(n))
    where = {}
    for r in rows:
        assert where.setdefault(r.part, r.p) == r.p
    if "temporal" not in strategy:
        return
    width = runs if strategy.startswith("hybrid") else 1
    groups = -(-12 // width)
    of = {}
    for r in rows:
        of.setdefault(r.t // width, set()).add(r.part)
    if groups < n:  # parts of its own for every group, the first ones one more where they do not come out even
        at = 0
        for i in range(groups):
            size = n // groups + (i < n % groups)
            assert of[i] <= set(range(at, at + size))
            at += size
        assert at == n
    else:
        assert all(len(parts) == 1 for parts in of.values())
        order = [min(of[i]) for i in range(groups)]
        sizes = [order.count(p) for p in range(n)]
        assert max(sizes) - min(sizes) <= 1
        assert order == ([i % n for i in range(groups)] if strategy == "naive_temporal" else sorted(order))


def test_partition_names_and_estimates():
    with pytest.raises(ValueError):
        partition.part_of("none", 4, 4)
    assert [partition.estimate_partitions(x) for x in (5, 100, 1000, 2000)] == [2, 16, 225, 248]


@pytest.mark.parametrize("strategy", partition.STRATEGIES)
def test_partitioned_graph_is_the_same_graph(spark, strategy):
    g = partition.partition_graph(graph(spark, U1, E1A), strategy, 3, 2)
    assert g.num_partitions() == (3, 3)
    same_v(g.vertices, U1)
    same_e(g.edges, E1A)

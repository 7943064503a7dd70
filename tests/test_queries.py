"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from chronoweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "date": "DATE", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(names) == columns
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry_module_works_without_the_training_modules(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_point_queries_and_zoom_do_not_run_python(spark):
    for name in ("zoom_week_most_e", "union_v", "degree_over_time", "attribute_zoom_e"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
        # Nested loops only against the one row of the graph's span: for vertices, edges, and vertices again in the constraint.
        assert plan.count("BroadcastNestedLoopJoin") <= (3 if name.startswith("zoom") else 0), name

"""The queries against their SQL in DuckDB on the smallest tables, and on a table of odd rows."""

import duckdb
import pytest

from chronoweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name, sf_dir, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in df.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    got, expected = sorted(tuple(r) for r in df.select(*columns).collect()), sorted(cursor.fetchall())
    assert got == [tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in r) for r in expected]


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(spark, name, SF, f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_its_sql_on_odd_rows(spark, name, odd, tmp_path):
    texts = [*odd, "password = 'hunter2222' é AKIA" + "A1B2" * 5 + " " + "0f1e2d3c" * 4 + " Zk9/q2Lm+8Vx0Tb7Rd4Yc1Wn6Hs3Jf5P", "A b\nA b\n c C c C c C"]
    rows = [(i, t, "en", ("s", "é", None, "z")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, name, str(tmp_path), tmp_path / "documents.parquet" / "*.parquet")

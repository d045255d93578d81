"""Every query that has SQL gives the same rows as the SQL."""

import pytest
from compare_rows import same

import __spark_entry__ as entry
from mirrorloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0


@pytest.mark.parametrize("rows, kinds, null", [(1_000_001, 7, "false"), (40, 40, "true")])
def test_validation_summary_of_large_and_missing_rows(spark, tmp_path, rows, kinds, null):
    import duckdb

    cell = f"CASE WHEN NOT {null} THEN id % {kinds} END"
    cols = [f"{cell} AS {c}" for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")] + ["id AS l_linenumber" if kinds == 40 else f"{cell} AS l_linenumber"]
    spark.range(rows).selectExpr(*cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same(QUERIES["validation_summary"](spark, str(tmp_path)), con.sql(SQL["validation_summary"]))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())

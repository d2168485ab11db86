"""Every layout query with SQL returns what DuckDB returns, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quireworks.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    cell = lambda v: None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(catalogue.ORACLES[name]).fetchdf())


def test_entry_point(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["visual_regions", "reflow_pages", "package_books", "run_in_headings"])
def test_ordered_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0

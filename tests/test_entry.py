"""The registered queries of the dialect against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from halfeven import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = sorted(repr(sorted(r.asDict().items())) for r in catalogue.queries()[name](spark, SF).collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(repr(sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name, where", [("pf3_computed_projection", "TRUE"), ("sf8_round_half_even", "TRUE"), ("sc7_derived_table", "l_quantity > 40")])
def test_every_row_of_lineitem_is_seen(spark, duck, name, where):
    assert catalogue.queries()[name](spark, SF).count() == duck.execute(f"SELECT count(*) FROM lineitem WHERE {where}").fetchone()[0]


def test_filters_and_columns_reach_the_scan(spark):
    s = catalogue.session(spark, SF)
    plan = s.query("SELECT o_orderkey FROM orders WHERE o_orderkey = 77")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,77)" in plan and "o_orderpriority" not in plan

"""Registered queries next to their SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import __spark_entry__ as entry  # noqa: E402
from check import canon  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ("d15_flight_summary", "d2_flight_density", "c1_asof_tolerance", "e17_persistence", "b5_map_filter", "f8_exact_split")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def check(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


@pytest.mark.parametrize("name", QUICK)
def test_quick(spark, con, name):
    check(spark, con, name)


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_every_query(spark, con, name):
    check(spark, con, name)


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(entry.queries())
    assert len(ORACLE) > 180


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1

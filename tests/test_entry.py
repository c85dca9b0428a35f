"""The driver's contract: names, the flagship query, and every SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kindred.plans import catalog

DATA = "/root/testdata/sf0.001"


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_flagship(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and 0 < row[0].macro_f_beta < 1


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    assert canonical(catalog.QUERIES[name](spark, DATA).toPandas()) == canonical(db.execute(catalog.ORACLES[name]).df())


#: Other views of the linkage that V3 runs here and that test_whole_linkage holds against a plain computation.
SAME = {"V4_calibration", "linkage_lists", "linkage_report"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SAME))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).limit(1).count() == 1

"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry
from tests.conftest import SF
from vitrine.plans.oracles import ORACLES
from vitrine.plans.queries import QUERIES

@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted_rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names])))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["users"] > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert _sorted_rows(got) == _sorted_rows(want)
    for c in got.column_names:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        assert a.replace("large_", "") == b.replace("large_", "")

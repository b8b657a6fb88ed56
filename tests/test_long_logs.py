"""A user of thousands of orders and an order of thousands of parts stay whole."""

import datetime as dt
import glob
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vitrine.plans.oracles import ORACLES
from vitrine.plans.queries import QUERIES
from vitrine.sources.orders import slate_tables

LONG_USER, ORDERS, PARTS, VECTORS = 7, 2000, 3000, 11


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    day = dt.datetime(2020, 1, 1)
    # the long user's orders, one order holding all parts, forty users of one order
    owners = [LONG_USER] * ORDERS + [3] + list(range(100, 140))
    keys = list(range(len(owners)))
    lines = [(k, (k * 37 + j) % PARTS, j) for k in keys for j in range(2)]
    lines += [(ORDERS, p, p + 2) for p in range(PARTS)]
    tables = {
        "orders": {"o_orderkey": keys, "o_custkey": owners,
                   "o_orderdate": [day + dt.timedelta(hours=k % 900) for k in keys],
                   "o_orderpriority": [f"{1 + k % 5}-X" for k in keys]},
        "lineitem": dict(zip(("l_orderkey", "l_partkey", "l_linenumber"), map(list, zip(*lines)))),
        "part": {"p_partkey": list(range(PARTS)), "p_type": [f"T{p % 3}" for p in range(PARTS)],
                 "p_brand": [f"B{p % 4}" for p in range(PARTS)]},
        "embeddings": {"vec_id": list(range(VECTORS)),
                       "embedding": [[float(v + d) / 64 for d in range(64)] for v in range(VECTORS)]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), root / f"{name}.parquet")
    return str(root)


def test_nothing_is_cut(spark, folder):
    t = slate_tables(spark, folder)
    assert QUERIES["explode_interactions"](spark, folder).count() == ORDERS + 41
    lengths = {r.user_id: r.n for r in t.log.selectExpr("user_id", "size(click) AS n").collect()}
    assert lengths[LONG_USER] == ORDERS and lengths[3] == 20
    shown = QUERIES["explode_exposures"](spark, folder).where("user_id = 3 AND item_id >= 3").count()
    assert shown > 0.9 * PARTS  # one part in fifty is unknown
    assert t.itemvec.count() == PARTS and t.items.count() == PARTS + 3
    shared = {tuple(r.vec) for r in t.itemvec.where(f"(id - 3) % {VECTORS} = 4").collect()}
    assert len(shared) == 1


@pytest.mark.parametrize("name", [
    "explode_interactions", "explode_exposures", "validate_log", "dataset_dims", "mask_type",
    "phase_mask", "scan_item_attr", "item_view_counts", "item_click_counts", "reward_by_step",
    "profile_linear", "profile_markov", "amortized_start", "slate_scores", "slate_loglik",
])
def test_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, folder).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    rows = [sorted(map(repr, zip(*[x.column(c).to_pylist() for c in names]))) for x in (got, want)]
    assert rows[0] == rows[1]

"""How the log is derived: few shuffles of narrow rows, and the numbering of users."""

import pyarrow as pa
import pyarrow.parquet as pq

from tests.conftest import SF
from vitrine.sources import orders


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_lines_are_shuffled_once(spark):
    assert _exchanges(orders.slates(spark, SF)) == 1


def test_log_is_written_without_another_shuffle(spark):
    users = orders.numbered_users(spark, SF)
    widths = users.selectExpr("transform(s, x -> size(x.slate)) w").collect()
    assert min(min(r.w) for r in widths) < 25  # padding is added after the last shuffle
    assert _exchanges(orders.wide_log(users)) == _exchanges(users)


def test_users_are_numbered_by_id(spark, tmp_path):
    tables = {
        # keys repeat, are null or have no lines
        "orders": {"o_orderkey": [1, 2, 2, 3, None, 5, 6], "o_custkey": [9, 4, 4, None, 9, 7, 9],
                   "o_orderdate": [1, 2, 3, 4, 5, 6, 0], "o_orderpriority": ["1-A", "2-B", None, "3", "4", "5", "5"]},
        "lineitem": {"l_orderkey": [1, 1, 1, 2, 3, None, 6], "l_partkey": [10, 11, 10, 12, 13, 14, 15],
                     "l_linenumber": [2, 3, 1, None, 1, 1, 1]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    log = orders.wide_log(orders.numbered_users(spark, str(tmp_path))).orderBy("row_idx").collect()
    # the orders of nobody count as the first user, who has no row
    assert [(r.row_idx, r.user_id) for r in log] == [(1, 4), (2, 9)]
    assert all(len(r.click) == len(r.slate) == 20 and len(r.slate[0]) == 25 for r in log)
    assert [list(r.slate_lengths[:3]) for r in log] == [[2, 2, 0], [2, 3, 0]]
    assert list(log[0].interaction_type[:3]) == [2, None, 0]

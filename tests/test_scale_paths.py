"""The ways taken at scale give what the small ways give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vitrine.functions import joins
from vitrine.functions.ranking import global_row_number, hash_cuts, hash_rank
from vitrine.functions.hashing import hash60
from vitrine.operators import recommend, split
from vitrine.sources.shared import cut_lineage


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_salted_gather_equals_broadcast(spark):
    # one id holds a third of the rows, a fifth has none
    key = F.when(F.col("n") % 3 == 0, 7).when(F.col("n") % 5 == 0, None).otherwise(F.col("n") % 100)
    rows = spark.range(3000).withColumnRenamed("id", "n").withColumn("item_id", key.cast("int"))
    table = spark.range(90).select(F.col("id").cast("int"), (F.col("id") * 2).alias("twice"))
    for how in ("inner", "left"):
        small = joins.gather(rows, table, "item_id", spread=("n",), how=how)
        large = joins.gather(rows, table, "item_id", spread=("n",), how=how, limit=0)
        cols = ["n", "item_id", "twice"]
        key = lambda r: (r["n"], r["item_id"] or -1)
        assert sorted(small.select(cols).collect(), key=key) == sorted(
            large.select(cols).collect(), key=key)


def test_hot_ids_are_few_and_salts_bounded(spark):
    rows = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    hot = joins.hot_ids(rows, "k").collect()
    assert [r["k"] for r in hot] == [1]
    assert 8 * joins.SALTS_PER_TASK / 3 <= hot[0]["_salts"] <= 8 * joins.SALTS_PER_TASK


def test_size_check(spark):
    table = vectors(spark, {i: [1.0] * 8 for i in range(100)})
    assert joins.fits_broadcast(table)
    assert not joins.fits_broadcast(table, 5_000)


def test_global_row_number(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"), (F.col("id") % 3).alias("g"))
    got = global_row_number(df, F.desc("g"), F.asc("id"), name="rn")
    rows = sorted(got.collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in rows] == list(range(500))
    assert [(r["g"], r["id"]) for r in rows] == sorted(
        ((r["g"], r["id"]) for r in rows), key=lambda x: (-x[0], x[1]))


def test_hash_rank_and_cuts(spark):
    users = spark.range(777).withColumnRenamed("id", "row_idx")
    h = hash60("x", F.col("row_idx"))
    want = sorted((r["h"], r["row_idx"]) for r in users.withColumn("h", h).collect())
    ranked = hash_rank(users, h, "row_idx", name="rn").collect()
    assert {r["row_idx"]: r["rn"] for r in ranked} == {t: i for i, (_, t) in enumerate(want)}
    cuts = hash_cuts(users, h, "row_idx", {
        "none": F.lit(0), "one": F.lit(1), "mid": F.lit(388), "all": F.lit(777)}).first()
    assert cuts["none"] is None
    assert tuple(cuts["one"]) == want[0]
    assert tuple(cuts["mid"]) == want[387]
    assert tuple(cuts["all"]) == want[776]


@pytest.mark.parametrize("dist", ["dot", "l2"])
def test_blocked_topk_equals_brute_force(spark, dist):
    rng = np.random.default_rng(3)
    users = {i: rng.normal(size=6) for i in range(60)}
    items = {3 + i: rng.normal(size=6) for i in range(200)}
    # a third of the items are copies: equal scores at the cut
    for i in range(0, 200, 3):
        items[3 + i] = items[3]
    u = vectors(spark, users).withColumnRenamed("id", "row_idx")
    v = vectors(spark, {**items, 0: np.full(6, 9.0), 1: np.full(6, 9.0), 2: np.full(6, 9.0)})
    got = recommend.topk_items(u, v, 8, dist, max_users=16, max_items=50)
    want = set()
    for i, x in users.items():
        scored = []
        for j, y in items.items():
            dot = 0.0
            for a, b in zip(x, y):
                dot += a * b
            if dist == "l2":
                xx = yy = 0.0
                for a, b in zip(x, y):
                    xx, yy = xx + a * a, yy + b * b
                dot = -np.sqrt(max(xx - 2 * dot + yy, 1e-10))
            scored.append((-dot, j))
        for rank, (_, j) in enumerate(sorted(scored)[:8], 1):
            want.add((i, j, rank))
    assert {(r["row_idx"], r["item_id"], r["rank"]) for r in got.collect()} == want
    # a list of targets gives the same lists
    short = recommend.topk_targets(u, v.withColumnRenamed("id", "item_id"), 8, dist)
    assert {(r["row_idx"], r["item_id"], r["rank"]) for r in short.collect()} == want


def test_fewer_items_than_k(spark):
    u = vectors(spark, {0: [1.0]}).withColumnRenamed("id", "row_idx")
    v = vectors(spark, {3: [1.0], 4: [2.0]})
    assert [r["item_id"] for r in recommend.topk_items(u, v, 5).orderBy("rank").collect()] == [4, 3]


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_results_do_not_depend_on_partitions(spark, tables, partitions):
    from vitrine.plans.queries import QUERIES
    from tests.conftest import SF

    names = ("batch_assign", "topk_items", "slate_loglik", "mf_sampled_loglik", "item_ctr")
    before = {n: _rows(QUERIES[n](spark, SF)) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in names:
            got = _rows(QUERIES[n](spark, SF))
            assert len(got) == len(before[n])
            for a, b in zip(got, before[n]):
                for x, y in zip(a, b):
                    assert x == y or abs(x - y) < 1e-5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("limit", [None, 0])
def test_slate_scores_same_without_broadcast(spark, tables, monkeypatch, limit):
    from vitrine.plans.queries import QUERIES
    from tests.conftest import SF

    want = _rows(QUERIES["slate_scores"](spark, SF))
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        for name in ("slate_scores", "gather_item_vectors", "item_category_name", "mf_sampled_loglik"):
            monkeypatch.setattr(joins, "BROADCAST_BYTES", 64 << 20)
            small = _rows(QUERIES[name](spark, SF))
            monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
            assert _rows(QUERIES[name](spark, SF)) == small
    assert _rows(QUERIES["slate_scores"](spark, SF)) == want


def test_split_does_not_shuffle_the_log(spark, tables):
    df = split.split_users_pct(tables.log, tables.users)
    plan = df._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.array(F.col("id")))
    assert _rows(cut_lineage(df)) == _rows(df)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_hot_order_customer_and_part(spark, tmp_path_factory, monkeypatch, limit):
    """A third of all rows in one order, one customer and one part."""
    import duckdb
    from tests.skewed import NAMES, write_skewed
    from tests.conftest import SF
    from vitrine.plans.oracles import ORACLES
    from vitrine.plans.queries import QUERIES

    folder = str(tmp_path_factory.mktemp("skewed"))
    write_skewed(SF, folder)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("scan_slate_log", "validate_log", "item_ctr", "gather_item_vectors", "slate_scores",
                 "mf_gradient", "profile_linear", "amortized_start", "hitrate"):
        got = QUERIES[name](spark, folder).toArrow()
        want = con.sql(ORACLES[name]).to_arrow_table()
        names = sorted(want.column_names)
        rows = lambda table: sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names])))
        assert rows(got) == rows(want), name

"""Top-k kernel, folds of long users, sampling without replacement, files of the fit."""

import glob
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import make_log, vectors
from vitrine.operators import profile, recommend, sampling, train
from vitrine.sources.shared import shared_folder

DIM = 3


# --- top-k ------------------------------------------------------------------------------

def _frames(spark, n_users=70, n_items=900, dim=6, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    users = {i: rng.normal(size=dim) for i in range(n_users)}
    items = {3 + i: rng.normal(size=dim) * np.exp(spread * rng.normal()) for i in range(n_items)}
    u = vectors(spark, users).withColumnRenamed("id", "row_idx")
    return users, items, u, vectors(spark, items)


def _brute(users, items, k, dist):
    out = set()
    for i, x in users.items():
        score = lambda y: float(x @ y) if dist == "dot" else -np.sqrt(max(((x - y) ** 2).sum(), 1e-10))
        best = sorted(((-score(y), j) for j, y in items.items()))[:k]
        out |= {(i, j, rank) for rank, (_, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("dist", ["dot", "l2"])
@pytest.mark.parametrize("round_bytes", [1, 20_000, 1 << 26])
def test_rounds_and_skipped_blocks_lose_nothing(spark, dist, round_bytes):
    users, items, u, v = _frames(spark)
    sc = spark.sparkContext
    tally = sc.accumulator(0), sc.accumulator(0)
    got = recommend.topk_items(u, v, 7, dist, max_users=16, max_items=100, round_bytes=round_bytes, tally=tally)
    assert {(r["row_idx"], r["item_id"], r["rank"]) for r in got.collect()} == _brute(users, items, 7, dist)
    assert {"dot": 0.2, "l2": 0.05}[dist] * tally[0].value < tally[1].value < tally[0].value


def test_users_are_not_shuffled(spark):
    _, _, u, v = _frames(spark)
    plan = recommend.best_lists(u.withColumn("t", F.lit(0)), v.select(F.col("id").cast("int").alias("item_id"), "vec"), 5)
    assert "Exchange" not in plan._jdf.queryExecution().toString()


def test_missing_vectors_and_empty_sides(spark):
    users, items, u, v = _frames(spark, 4, 5)
    none = vectors(spark, {}).where("false")
    assert recommend.topk_items(u, none, 3).count() == 0
    assert recommend.topk_items(u.where("false"), v, 3).count() == 0
    more = v.unionByName(spark.createDataFrame([(99, None)], v.schema))
    odd = u.unionByName(spark.createDataFrame([(77, None)], u.schema))
    got = {(r["row_idx"], r["item_id"], r["rank"]) for r in recommend.topk_items(odd, more, 3).collect()}
    assert got == _brute(users, items, 3, "dot")


def test_a_state_is_ranked_once_for_its_steps(spark):
    _, _, u, v = _frames(spark, 3, 20)
    states = u.withColumns({"t": F.lit(4), "last": F.lit(6)})
    got = recommend.topk_states(states, v, 2).collect()
    assert Counter(r["t"] for r in got) == {4: 6, 5: 6, 6: 6}
    assert len({(r["row_idx"], r["rank"], r["item_id"]) for r in got}) == 6


def test_thompson_follows_the_drawn_vectors(spark):
    rng = np.random.default_rng(5)
    items = {i: rng.normal(size=DIM) for i in range(3, 40)}
    post = vectors(spark, items).withColumn("scale", F.array_repeat(F.lit(0.7), DIM))
    clicks = {10: [5, 1, 30, 2, 11], 11: [], 12: [7] * 6}
    starts = {u: rng.normal(size=DIM) for u in clicks}
    log = make_log(spark, {u: [([1, max(c, 3)], c) for c in cs] for u, cs in clicks.items()})
    k = 4

    def follow(drawn):
        began = vectors(spark, starts).withColumn("vec", F.flatten(F.array_repeat("vec", k)))
        clicked = profile.click_vectors(log, drawn)
        return profile.state_at(profile.fold_linear(profile.profile_start(clicked, "normal", DIM, began), 0.6))

    got = recommend.topk_inslate_thompson(follow, post, k, seed=9)
    lists = {}
    for r in got.orderBy("row_idx", "rank").collect():
        lists.setdefault(r.row_idx, []).append(r.item_id)
    draws = {}
    for r in sampling.posterior_draw(post, range(k), 1.0, 9).collect():
        draws.setdefault(r.draw, {})[r.id] = np.array(r.vec)
    for row, (user, cs) in enumerate(clicks.items()):
        ranked = []
        for d in range(k):
            h = starts[user]
            for c in cs:
                h = 0.6 * h + 0.4 * draws[d][c] if c >= 3 else h
            ranked.append(sorted(draws[d], key=lambda i: (-float(h @ draws[d][i]), i))[:k])
        want = list(dict.fromkeys(ranked[d][r] for r in range(k) for d in range(k)))[:k]
        assert lists[row] == want


# --- folds of long users ----------------------------------------------------------------

@pytest.fixture(scope="module")
def long_user(spark):
    rng = np.random.default_rng(2)
    items = {i: rng.normal(size=DIM) for i in range(3, 30)}
    clicks = {1: [int(c) for c in rng.choice([0, 1, 2, *range(3, 32)], 700)], 2: [5], 3: []}  # 30, 31 have no vector
    starts = {u: rng.normal(size=DIM) for u in clicks}
    log = make_log(spark, {u: [([1], c) for c in cs] for u, cs in clicks.items()}, n_steps=700)
    return items, clicks, starts, log, vectors(spark, items), vectors(spark, starts)


def _want(clicks, h, items, step, n=700):
    out = [h]
    for t in range(n):
        c = clicks[t] if t < len(clicks) else 0
        h = step(h, items[c]) if c in items else h
        out.append(h)
    return out


def _states(folded):
    return {(r.user_id, r.t): np.array(r.vec) for r in profile.step_states(folded).collect()}


@pytest.mark.parametrize("keep", [(), ("click", "slate")])
@pytest.mark.parametrize("segment", [1, 7, 64, 4096])
def test_segments_compose(long_user, keep, segment):
    items, clicks, starts, log, itemvec, uservec = long_user
    started = profile.profile_start(profile.click_vectors(log, itemvec, keep), "normal", DIM, uservec)
    got = _states(profile.fold_linear(started, 0.8, segment=segment))
    assert len(got) == 3 * 701
    for u, cs in clicks.items():
        for t, h in enumerate(_want(cs, starts[u], items, lambda h, v: 0.8 * h + 0.2 * v)):
            assert np.allclose(got[u, t], h, atol=1e-12)
    if not keep:
        last = {r.user_id: np.array(r.vec) for r in profile.state_at(profile.fold_linear(started, 0.8, segment=segment)).collect()}
        assert all(np.array_equal(last[u], got[u, 700]) for u in clicks)


def test_recurrent_fold_of_a_long_user_in_small_batches(spark, long_user):
    items, clicks, starts, log, itemvec, uservec = long_user
    rng = np.random.default_rng(4)
    w = {k: rng.normal(size=(DIM, DIM)) for k in ("z", "ir", "id", "in", "hr", "hd", "hn")}
    step, put = profile.gru_cell(w)
    started = profile.profile_start(profile.click_vectors(log, itemvec), "normal", DIM, uservec)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = _states(profile.fold_linear_gru(started, 0.8, w))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u, cs in clicks.items():
        a = _want(cs, starts[u][None], items, step)
        b = _want(cs, starts[u], items, lambda h, v: 0.8 * h + 0.2 * v)
        for t, (x, y) in enumerate(zip(a, b)):
            assert np.allclose(got[u, t], (put(x)[0] + y) / 2, atol=1e-9)


def test_users_without_a_start_are_left_out(spark, long_user):
    *_, log, itemvec, uservec = long_user
    started = profile.profile_start(profile.click_vectors(log, itemvec), "normal", DIM, uservec.where("id <> 1"))
    for segment in (8, 4096):
        assert {u for u, _ in _states(profile.fold_linear(started, 0.8, segment=segment))} == {2, 3}


def test_distinct_states_cover_all_steps(long_user):
    *_, log, itemvec, uservec = long_user
    folded = profile.fold_markov(profile.click_vectors(log, itemvec), DIM)
    spans = sorted((r.user_id, r.t, r.last) for r in profile.distinct_states(folded, upto=300).collect())
    for u in (1, 2, 3):
        mine = [(a, b) for v, a, b in spans if v == u]
        assert mine[0][0] == 0 and mine[-1][1] == 300 and all(x[1] + 1 == y[0] for x, y in zip(mine, mine[1:]))


# --- sampling, fit ----------------------------------------------------------------------

@pytest.mark.parametrize("n", [7, 12])
def test_random_recommender_is_uniform(spark, n):
    users = spark.range(9000).select(F.col("id").alias("user_id"))
    lists = [r.recs for r in sampling.random_recommender(users, F.lit(n), 4).collect()]
    ids = n - 2
    assert all(len(set(x)) == 4 for x in lists)
    share = Counter(i for x in lists for i in x)
    assert set(share) == set(range(2, n))
    assert all(abs(c / 9000 - 4 / ids) < 0.035 for c in share.values())
    first = Counter(x[0] for x in lists)
    assert all(abs(first[i] / 9000 - 1 / ids) < 0.03 for i in range(2, n))


@pytest.mark.parametrize("n", [0, 2, 3])
def test_random_recommender_of_a_tiny_range(spark, n):
    users = spark.range(2).select(F.col("id").alias("user_id"))
    assert [r.recs for r in sampling.random_recommender(users, F.lit(n), 4).collect()] == [[2] if n == 3 else []] * 2


def test_fit_keeps_three_copies_at_most(spark):
    steps = spark.createDataFrame(
        [(u, u, t, 3 + (u + t) % 5, "valid" if t == 3 else "train") for u in range(6) for t in range(4)],
        "row_idx bigint, user_id bigint, t int, click int, phase string")
    folder = shared_folder(spark)
    before = set(glob.glob(os.path.join(folder, "cut-*")))
    users, items, metrics = train.mf_fit(
        steps, spark.range(6), spark.range(3, 8), F.lit(8), dim=2, epochs=6, lr=0.05)
    kept = set(glob.glob(os.path.join(folder, "cut-*"))) - before
    assert len(kept) <= 1 + 3 * 2
    assert metrics.count() == 6 and users.count() == 6 and items.count() == 5

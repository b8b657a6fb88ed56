"""Profiles and fitting against step-by-step numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, make_log, vectors
from vitrine.operators import profile, sampling, split, train
from vitrine.plans.module import SlateModule

DIM = 4


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(0)
    items = {i: rng.normal(size=DIM) for i in range(3, 12)}
    starts = {u: rng.normal(size=DIM) for u in (10, 11, 12, 13)}
    clicks = {10: [5, 1, 3, 2, 11], 11: [], 12: [1, 1], 13: [3 + t % 9 for t in range(20)]}
    log = make_log(spark, {u: [([1, max(c, 3)], c) for c in cs] for u, cs in clicks.items()})
    clicked = profile.click_vectors(log, vectors(spark, items))
    started = profile.profile_start(clicked, "normal", DIM, vectors(spark, starts))
    return items, starts, clicks, log, clicked, started


def _fold(clicks, h, step, out=lambda h: h, n=20):
    states = [out(h)]
    for t in range(n):
        c = clicks[t] if t < len(clicks) else 0
        if c >= 3:
            h = step(h, c)
        states.append(out(h))
    return states


def _check(df, want):
    got = {(r.user_id, r.t): r.vec for r in profile.step_states(df).collect()}
    assert len(got) == sum(len(s) for s in want.values()) == 4 * 21
    for u, states in want.items():
        for t, s in enumerate(states):
            assert np.allclose(got[u, t], s, atol=1e-12)


def _gru(w, items):
    sig = lambda x: 1 / (1 + np.exp(-x))

    def step(h, c):
        x = items[c]
        r = sig(w["ir"] @ x + w["hr"] @ h)
        u = sig(w["id"] @ x + w["hd"] @ h)
        n = np.tanh(w["in"] @ x + r * (w["hn"] @ h))
        return (1 - u) * n + u * h

    return step


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(1)
    return {k: rng.normal(size=(DIM, DIM)) for k in ("z", "ir", "id", "in", "hr", "hd", "hn")}


def test_linear(setup):
    items, starts, clicks, _, _, started = setup
    step = lambda h, c: 0.7 * h + 0.3 * items[c]
    _check(profile.USER_MODELS["linear"](started, dim=DIM, gamma=0.7),
           {u: _fold(cs, starts[u], step) for u, cs in clicks.items()})


def test_markov_starts_at_zero(setup):
    items, _, clicks, _, clicked, _ = setup
    _check(profile.USER_MODELS["markov"](clicked, dim=DIM),
           {u: _fold(cs, np.zeros(DIM), lambda h, c: items[c]) for u, cs in clicks.items()})


def test_gru(setup, weights):
    items, starts, clicks, _, _, started = setup
    want = {u: _fold(cs, starts[u], _gru(weights, items), lambda h: weights["z"] @ h)
            for u, cs in clicks.items()}
    _check(profile.USER_MODELS["gru"](started, weights=weights), want)


def test_gru_over_many_batches(spark, setup, weights):
    items, starts, clicks, _, _, started = setup
    want = {u: _fold(cs, starts[u], _gru(weights, items), lambda h: weights["z"] @ h)
            for u, cs in clicks.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        _check(profile.fold_gru(started.coalesce(1), weights), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_linear_gru_is_the_mean(setup, weights):
    items, starts, clicks, _, _, started = setup
    lin = lambda h, c: 0.7 * h + 0.3 * items[c]
    want = {}
    for u, cs in clicks.items():
        g = _fold(cs, starts[u], _gru(weights, items), lambda h: weights["z"] @ h)
        want[u] = [(a + b) / 2 for a, b in zip(g, _fold(cs, starts[u], lin))]
    _check(profile.USER_MODELS["lingru"](started, gamma=0.7, weights=weights), want)


def test_state_at_and_steps(setup):
    items, starts, clicks, log, _, _ = setup
    folded = profile.fold_linear(profile.profile_start(
        profile.click_vectors(log, vectors(log.sparkSession, items), ("click", "slate")),
        "normal", DIM, vectors(log.sparkSession, starts)), 0.7)
    every = {(r.user_id, r.t): r.vec for r in profile.step_states(folded).collect()}
    for t in (0, 3, 20):
        for r in profile.state_at(folded, t).collect():
            assert r.vec == every[r.user_id, t]
    for r in profile.state_at(folded).collect():
        assert r.vec == every[r.user_id, 20]
    steps = profile.steps_with_state(folded, ("click", "slate")).collect()
    assert len(steps) == sum(len(c) for c in clicks.values())
    for r in steps:
        assert r.z == every[r.user_id, r.t]


def test_start_models(spark, setup):
    _, starts, _, log, _, _ = setup
    users, table = log.select("user_id"), vectors(spark, starts)
    zero = profile.profile_start(users, "zero", 3).first()
    assert zero.h0 == [0.0] * 3
    matrix = np.arange(8.0).reshape(2, 4).tolist()
    for r in profile.profile_start(users, "compact_normal", 2, table, matrix).collect():
        assert np.allclose(r.h0, np.array(matrix) @ starts[r.user_id])
    with pytest.raises(ValueError):
        profile.profile_start(users, "other", 3, table)


@pytest.mark.parametrize("reserved", [False, True])
def test_amortized_start(spark, setup, reserved):
    items, _, clicks, log, _, _ = setup
    full = {i: np.zeros(DIM) for i in range(3)} | items
    if reserved:
        full[1] = np.ones(DIM)
    marked = split.mask_type(log.withColumn("split", F.lit("valid")), 3)
    given = full if reserved else items
    got = {r.user_id: r for r in profile.amortized_start(
        marked, vectors(spark, given), DIM, 0.7, 0.2, reserved=reserved).collect()}
    for u, cs in clicks.items():
        seq = np.array(cs + [0] * (20 - len(cs)))
        pos = (seq > 3).astype(float)                       # item 3 carries no weight
        w = pos / (np.cumsum(pos) ** 0.7 + 1e-5) * (np.arange(20) < 3)
        w = w / (w.sum() + 1e-5)
        v = np.array([full[c] for c in seq])
        w2 = pos / (pos.sum() + 1e-5)
        spread = (((v - v.mean(0)) ** 2) * w2[:, None]).sum(0)
        assert np.allclose(got[u].vec, (v * w[:, None]).sum(0))
        assert np.allclose(got[u].scale, 0.2 * np.sqrt(spread + 1e-6))


# ---- matrix factorization

def _steps(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), int(u), int(t), int(rng.integers(3, 9)), [int(x) for x in rng.integers(3, 9, 3)])
            for u in range(5) for t in range(4)]
    return rows, spark.createDataFrame(
        rows, "row_idx bigint, user_id bigint, t int, click int, allitem array<int>")


def _np_loglik(rows, u, v):
    total, gu, gv = 0.0, {i: np.zeros(3) for i in u}, {i: np.zeros(3) for i in v}
    for _, user, _, click, neg in rows:
        ids = [click, *neg]
        s = np.array([u[user] @ v[i] for i in ids])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        total += np.log(p[0])
        for j, i in enumerate(ids):
            q = (j == 0) - p[j]
            gu[user] += q * v[i]
            gv[i] += q * u[user]
    return total, gu, gv


def test_gradient_equals_numpy_and_differences(spark):
    rng = np.random.default_rng(6)
    u = {i: rng.normal(size=3) for i in range(5)}
    v = {i: rng.normal(size=3) for i in range(3, 9)}
    rows, steps = _steps(spark)
    pulls = train.mf_pulls(train.mf_rows(steps, vectors(spark, u), vectors(spark, v)), 3)
    du, dv = train.mf_gradient(pulls, 3)
    total, gu, gv = _np_loglik(rows, u, v)
    for df, want in ((du, gu), (dv, gv)):
        for r in df.collect():
            assert np.allclose(r.vec, want[r.id])
    assert pulls.agg(F.sum("loglik")).first()[0] == pytest.approx(total)
    bumped = {**v, 4: v[4] + np.array([0, 1e-6, 0])}
    assert (_np_loglik(rows, u, bumped)[0] - total) / 1e-6 == pytest.approx(gv[4][1], abs=1e-4)


def test_init_range_is_reproducible(spark):
    ids = spark.range(50)
    one = train.mf_init(ids, 9, "user").collect()
    assert one == train.mf_init(ids.repartition(3), 9, "user").orderBy("id").collect()
    xs = np.array([r.vec for r in one])
    assert xs.shape == (50, 9) and np.abs(xs).max() <= 0.05 and np.abs(xs.mean()) < 0.01


def test_fit_equals_numpy_adamw(spark):
    rows, steps = _steps(spark)
    real = steps.drop("allitem")
    lr, epochs = 0.05, 3
    both = real.withColumn("phase", F.lit("train")).unionByName(
        real.where("user_id < 2").withColumn("phase", F.lit("valid")))
    users, items, metrics = train.mf_fit(
        both, spark.range(6), spark.range(3, 9), F.lit(9), 3, epochs, 2, lr)
    init = lambda ids, name: {r.id: np.array(r.vec) for r in train.mf_init(ids, 3, name).collect()}
    p = {"u": init(spark.range(6), "user"), "v": init(spark.range(3, 9), "item")}
    m = {k: {i: np.zeros(3) for i in t} for k, t in p.items()}
    s = {k: {i: np.zeros(3) for i in t} for k, t in p.items()}
    logged = []

    def drawn(phase, epoch, frame):
        return [(r.row_idx, r.user_id, r.t, r.click, r.allitem) for r in sampling.sample_candidates(
            frame, F.lit(9), 2, 1, phase, epoch).collect()]

    best = None
    for epoch in range(epochs):
        ll, gu, gv = _np_loglik(drawn("train", epoch, real), p["u"], p["v"])
        for k, g in (("u", gu), ("v", gv)):
            for i in p[k]:
                grad = -g[i]
                m[k][i] = 0.9 * m[k][i] + 0.1 * grad
                s[k][i] = 0.999 * s[k][i] + 0.001 * grad**2
                mh, sh = m[k][i] / (1 - 0.9 ** (epoch + 1)), s[k][i] / (1 - 0.999 ** (epoch + 1))
                p[k][i] = p[k][i] * (1 - lr * 0.01) - lr * mh / (np.sqrt(sh) + 1e-8)
        held = _np_loglik(drawn("valid", epoch, real.where("user_id < 2")), p["u"], p["v"])[0]
        logged.append((epoch, ll, held))
        if best is None or held > best[0]:
            best = (held, {k: {i: x.copy() for i, x in t.items()} for k, t in p.items()})
    for got, want in zip(metrics.orderBy("epoch").collect(), logged):
        assert tuple(got) == pytest.approx(want)
    for df, k in ((users, "u"), (items, "v")):
        got = {r.id: r.vec for r in df.collect()}
        assert set(got) == set(best[1][k])
        for i, x in best[1][k].items():
            assert np.allclose(got[i], x)


def test_module_end_to_end(spark, tables):
    module = SlateModule(spark, tables.root, batch_size=64, sample_candidate_items=4,
                         valid_pct=0.2, test_pct=0.2, limit_num_users=100).setup()
    assert module.dims["num_interactions"] == 20
    assert module.log.count() == 100
    assert module.phase("train").count() == 100 and module.phase("test").count() == 20
    steps = module.steps()
    assert {r.phase for r in steps.select("phase").distinct().collect()} == {"train", "valid", "test"}
    assert steps.where(F.size("allitem") != 4).count() == 0
    assert module.batches().where("phase = 'train'").agg(F.max("batch_id")).first()[0] == 1
    users, items, log = module.fit(dim=3, epochs=2, lr=0.05)
    assert log.count() == 2
    r = module.hitrate(users, items, 10).first()
    assert r.users == 20 and r.hits >= 0

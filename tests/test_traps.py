"""Hand-written logs for the semantics that change an answer."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_log, vectors
from vitrine.functions.vectors import SCORES
from vitrine.operators import (
    attach, metrics, profile, recommend, reshape, sampling, scoring, split, stats, validate,
)
from vitrine.schema import FIRST_REAL
from vitrine.sources import log as logs


@pytest.fixture(scope="module")
def log(spark):
    return make_log(spark, {
        100: [([1, 5, 6, 7], 6, 1), ([1, 8], 1, 2), ([1, 3, 9], 3, 2)],
        101: [],                                           # all padding
        102: [([1, 4], 1, 0)] * 4,                         # only no-clicks
        103: [([1, 2, 5], 2, 1), ([1, 5, 4], 5, 1)],       # click on the unknown item
        104: [([1, 3 + t % 5, 9], 3 + t % 5) for t in range(20)],
    })


def _col(df, c):
    return [r[c] for r in df.collect()]


# ---- dimensions and checks

def test_dims_are_upper_bounds(spark, log):
    vocab = spark.createDataFrame(
        [("interaction_type", i, str(i)) for i in range(3)], "attr string, idx int, value string")
    d = validate.dataset_dims(log, vocab).first()
    assert (d.num_items, d.num_interactions, d.maxlen_slate) == (10, 20, 25)
    assert (d.num_users, d.num_interaction_types) == (105, 3)


def test_validate_sound_log(log):
    assert set(_col(validate.validate_log(log), "violations")) == {0}


def test_validate_names_missing_column(log):
    found = dict(map(tuple, validate.validate_log(log.drop("slate")).collect()))
    assert found["has_slate"] == 1 and found["has_click"] == 0


def test_validate_finds_unequal_lengths_and_wrong_clicks(spark, log):
    short = log.withColumn("click", F.when(F.col("row_idx") == 0, F.slice("click", 1, 19)).otherwise(F.col("click")))
    assert dict(map(tuple, validate.validate_log(short).collect()))["steps_click"] == 1
    wrong = log.withColumn("click_idx", F.transform("click_idx", lambda x: x + 1))
    assert dict(map(tuple, validate.validate_log(wrong).collect()))["click_in_slate"] > 0


def test_checksum_columns(log):
    rows = dict(map(tuple, validate.checksum_columns(
        split.mask_type(log.withColumn("split", F.lit("train")))).collect()))
    clicks = [6, 1, 3] + [1] * 4 + [2, 5] + [3 + t % 5 for t in range(20)]
    assert rows["click"] == pytest.approx(sum(clicks) / 100)
    assert rows["mask_type"] == 1.0
    assert rows["total"] == pytest.approx(sum(v for k, v in rows.items() if k != "total"))


# ---- reshaping

def test_lookup_worked_example(spark):
    log = make_log(spark, {u: [([1, 10, 11], 1)] * 3 + [([1, 20, 21, 22, 23, 24, 25], 23)] for u in range(6)})
    r = reshape.interaction_lookup(log, 3, row_idx=5).first()
    assert (r.slate_length, r.click_idx, r.click) == (7, 4, 23)
    assert r.slate[:7] == [1, 20, 21, 22, 23, 24, 25] and set(r.slate[7:]) == {0}


def test_no_click_counts_towards_length_and_padding_is_dropped(log):
    rows = reshape.explode_interactions(log, ("slate", "slate_lengths")).collect()
    assert len(rows) == 3 + 4 + 2 + 20
    for r in rows:
        assert r.slate[0] == 1 and r.slate_length == sum(x != 0 for x in r.slate)
    assert reshape.explode_interactions(log, ("click",), drop_pad=False).count() == 100


def test_pack_is_inverse_of_explode(log):
    rows = reshape.explode_interactions(log).join(
        reshape.pack_slates(reshape.explode_exposures(log)).withColumnRenamed("slate", "s2"),
        ["row_idx", "user_id", "t"]).drop("slate").withColumnRenamed("s2", "slate")
    packed = {r.row_idx: r for r in reshape.pack_interactions(rows).collect()}
    for want in log.collect():
        if any(want.click):
            got = packed[want.row_idx]
            for c in ("click", "click_idx", "slate_lengths", "interaction_type", "slate"):
                assert got[c] == want[c]
        else:
            assert want.row_idx not in packed  # an empty user has no rows to pack


def test_pack_keeps_gaps_and_long_slates_whole(spark):
    rows = spark.createDataFrame(
        [(0, 7, 2, 5, 1, 3, 1, [1, 5, 6]), (0, 7, 0, 4, 1, 30, 2, [1, 4] + list(range(10, 38)))],
        "row_idx bigint, user_id bigint, t int, click int, click_idx int, slate_length int,"
        " interaction_type int, slate array<int>")
    r = reshape.pack_interactions(rows, 4, 25).first()
    assert r.click == [4, 0, 5, 0] and len(r.slate[0]) == 30 and len(r.slate[1]) == 25


def test_left_padding_keeps_last(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), (list(range(3, 30)),)], "c array<int>")
    got = _col(df.select(reshape.left_pad_history("c", 5).alias("h")), "h")
    assert got == [[0, 0, 5, 6, 7], [0] * 5, [25, 26, 27, 28, 29]]


def test_history_cut(log):
    r = reshape.history_cut(log, 2).where("row_idx = 0").first()
    assert r.click[:4] == [6, 1, 0, 0] and sum(r.slate[2]) == 0 and r.slate[1][:2] == [1, 8]


def test_phase_clicks_drop_padding(log):
    masked = log.withColumn("phase_mask", F.transform("click", lambda x, t: t >= 1))
    rows = {r.row_idx: r.clicks for r in reshape.phase_clicks(masked).collect()}
    assert rows[0] == [1, 3] and rows[1] == []
    kept = reshape.phase_clicks(masked, keep_pad=True).where("row_idx = 1").first()
    assert kept.clicks == [0] * 19


def test_click_position_absent(spark):
    df = spark.createDataFrame([([1, 4, 5], 5), ([1, 4, 5], 9)], "s array<int>, c int")
    assert _col(df.select(reshape.click_position("s", F.col("c")).alias("p")), "p") == [2, -1]


def test_narrow_refuses_large_ids(spark, log):
    wide = log.withColumn("click", F.lit([2**40]).cast("array<bigint>"))
    with pytest.raises(Exception, match="OVERFLOW"):
        logs.narrow_ids(wide).collect()


# ---- splits

def _split_sizes(spark, n, fn):
    users = spark.range(n).withColumnRenamed("id", "row_idx")
    got = fn(users, users).groupBy("split").count().collect()
    return {r["split"]: r["count"] for r in got}


@pytest.mark.parametrize("n,pct,ratio", [(100, 5, 4), (1500, 75, 74), (15000, 750, 749), (3, 0, 0)])
def test_the_two_split_sizes(spark, n, pct, ratio):
    for fn, k in ((split.split_users_pct, pct), (split.split_users_ratio, ratio)):
        sizes = _split_sizes(spark, n, fn)
        assert sizes.get("valid", 0) == sizes.get("test", 0) == k
        assert sizes["train"] == n - 2 * k


def test_every_interaction_in_one_phase(spark):
    log = make_log(spark, {u: [([1, 4], 4)] * (u % 21) for u in range(60)})
    users = log.select("row_idx")
    marked = split.split_users_pct(log, users, 0.2, 0.2)
    masks = split.phase_mask(marked).collect()
    seen = {}
    for r in masks:
        for t, m in enumerate(r.phase_mask):
            seen[r.row_idx, t] = seen.get((r.row_idx, t), 0) + m
    assert set(seen.values()) == {1} and len(seen) == 60 * 20
    # train holds all users; held-out users give it their first steps
    assert sum(r.phase == "train" for r in masks) == 60
    held = [r for r in masks if r.phase == "train" and r.split != "train"]
    assert len(held) == 24 and all(sum(r.phase_mask) == 5 for r in held)


def test_mask_type_never_zero_and_matches_phase(spark, log):
    marked = split.mask_type(split.split_users_pct(log, log.select("row_idx"), 0.4, 0.4))
    for r in marked.collect():
        late = {"train": 1, "valid": 2, "test": 3}[r.split]
        assert r.mask_type == [1] * 5 + [late] * 15
    rows = split.phase_mask_from_type(marked).collect()
    assert len(rows) == 3 * 5
    for u in range(5):
        per = [r.phase_mask for r in rows if r.row_idx == u]
        assert all(sum(m) == 1 for m in zip(*per))


def test_batches(spark):
    users = spark.range(250).select(F.col("id").alias("row_idx"))
    marked = split.split_users_pct(users, users, 0.1, 0.1)
    one, two = (split.batch_assign(marked, 40, e).collect() for e in (0, 1))
    sizes = {}
    for r in one:
        sizes[r.phase, r.batch_id] = sizes.get((r.phase, r.batch_id), 0) + 1
    assert [sizes["train", b] for b in range(7)] == [40] * 6 + [10]
    assert sizes["valid", 0] == sizes["test", 0] == 25
    place = lambda rows, p: {r.row_idx: (r.batch_id, r.batch_pos) for r in rows if r.phase == p}
    assert place(one, "train") != place(two, "train")      # reshuffled
    assert place(one, "valid") == place(two, "valid")      # in order


# ---- sampling

def test_candidates_cover_every_step_and_are_real(spark, log):
    steps = reshape.explode_interactions(log, ("click",), drop_pad=False)
    rows = sampling.sample_candidates(steps, F.lit(10), 6).collect()
    assert len(rows) == 100
    drawn = [x for r in rows for x in r.allitem]
    assert set(drawn) == set(range(3, 10))
    assert any(len(set(r.allitem)) < 6 for r in rows)       # with replacement
    assert any(r.click in r.allitem for r in rows)          # may hit the positive


def test_uniform_slate_quirks(log):
    steps = reshape.explode_interactions(log, ("click", "slate"), drop_pad=False)
    for r in sampling.sample_uniform_slate(steps, F.lit(10)).collect():
        assert len(r.slate) == 25 and r.slate[0] == 1
        assert r.click_idx == (0 if r.click == 1 else 1)
        if r.click != 1:                                    # padding and unknown too
            assert r.slate[1] == r.click
        else:
            assert r.slate[1] >= 3
        assert min(r.slate[2:]) >= 3


@pytest.mark.parametrize("n,k,want", [(500, 24, 24), (30, 24, 24), (27, 25, 25), (10, 24, 8)])
def test_random_recommender_distinct(spark, n, k, want):
    users = spark.range(40).select(F.col("id").alias("user_id"))
    rows = _col(sampling.random_recommender(users, F.lit(n), k), "recs")
    for recs in rows:
        assert len(recs) == len(set(recs)) == want
        assert min(recs) >= 2 and max(recs) < n
    assert len({tuple(r) for r in rows}) > 1


def test_posterior_draws(spark):
    post = vectors(spark, {i: [1.0] * 50 for i in range(40)}).withColumn(
        "scale", F.array_repeat(F.lit(0.5), 50))
    mean = sampling.posterior_draw(post, [0, 1], temp=0).collect()
    assert len(mean) == 80 and all(r.vec == [1.0] * 50 for r in mean)
    xs = [x for r in sampling.posterior_draw(post, [0]).collect() for x in r.vec]
    m = sum(xs) / len(xs)
    sd = math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))
    assert abs(m - 1.0) < 0.05 and abs(sd - 0.5) < 0.05


def test_sample_click_follows_scores(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("row_idx"), F.col("id").alias("user_id"), F.lit(0).alias("t"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(s).alias("score"))
                            for p, s in enumerate((0.0, math.log(3.0), -100.0))])).alias("x"),
    ).select("row_idx", "user_id", "t", "x.pos", "x.score")
    got = _col(sampling.sample_click(rows), "pos")
    assert len(got) == 2000 and set(got) == {0, 1}
    assert abs(got.count(1) / 2000 - 0.75) < 0.04


# ---- statistics

def test_ratios(log):
    assert stats.noclick_ratio(log).first()[0] == pytest.approx(5 / 29)
    assert stats.avg_slate_length(log).first()[0] == pytest.approx((4 + 2 + 3 + 8 + 3 + 3 + 60) / 29)
    assert stats.recommendation_ratio(log).first()[0] == pytest.approx(2 / 25)
    assert stats.avg_interactions_per_user(log).first()[0] == pytest.approx(29 / 5)


def test_counts_include_reserved_ids_and_zeros(spark, log):
    clicks = dict(map(tuple, stats.item_click_counts(log, F.lit(12)).collect()))
    views = dict(map(tuple, stats.item_view_counts(log, F.lit(12)).collect()))
    assert set(clicks) == set(views) == set(range(12))
    assert clicks[0] == 100 - 29 and clicks[1] == 5 and clicks[2] == 1 and clicks[11] == 0
    assert views[0] == 2500 - 83 and views[1] == 29 and views[10] == 0
    ctr = {r.item_id: r.ctr for r in stats.item_ctr(
        stats.item_click_counts(log, F.lit(12)), stats.item_view_counts(log, F.lit(12)), 5).collect()}
    assert ctr[3] == pytest.approx(5 / 5) and ctr[8] == 0.0 and ctr[11] == 0.0
    both = {r.item_id: (r.clicks, r.views) for r in stats.item_counts(log, F.lit(12)).collect()}
    assert both == {i: (clicks[i], views[i]) for i in range(12)}


def test_id_range_spans_blocks(spark):
    ids = sorted(_col(stats.id_range(spark, F.lit(9000).cast("bigint")), "item_id"))
    assert ids == list(range(9000))


def test_histogram_edges(spark):
    views = spark.createDataFrame(
        [(0, 5000), (1, 5000), (2, 5000), (3, 0), (4, 10), (5, 1000), (6, 1001), (7, 999)],
        "item_id int, views bigint")
    bins = dict(map(tuple, stats.popularity_histogram(views).collect()))
    assert len(bins) == 100 and bins[0] == 4 and bins[1] == 1 and bins[99] == 2
    assert sum(bins.values()) == 7                          # 1001 is outside
    edges = spark.range(0, 1000, 10).select(F.col("id").alias("views"), F.lit(5).alias("item_id"))
    assert set(_col(stats.popularity_histogram(edges), "n")) == {1}    # 290 opens bin 29
    same = stats.value_histogram(views.where("item_id < 3"), F.col("views"), 4)
    assert sum(_col(same, "n")) == 3


def test_best_epoch_first_on_ties(spark):
    rows = [(0, "valid/ll", 1.0), (1, "valid/ll", 3.0), (2, "valid/ll", 3.0),
            (0, "train/ll", 9.0), (1, "train/ll", 5.0), (2, "train/ll", 6.0)]
    epochs = spark.createDataFrame(rows, "epoch int, key string, value double")
    got = stats.best_epoch(epochs, "valid/ll", ("train/ll", "valid/ll")).first()
    assert tuple(got) == (1, 5.0, 3.0)


def test_phase_epoch_mean(spark):
    rows = [(0, "train", b, "ll", float(b)) for b in range(4)] + [(0, "valid", 0, "ll", 7.0)]
    m = spark.createDataFrame(rows, "epoch int, phase string, batch_id bigint, name string, value double")
    got = {r.phase: r.value for r in stats.phase_epoch_mean(m).collect()}
    assert got == {"train": 1.5, "valid": 7.0}


# ---- names

def test_vocab_keys(spark, tmp_path):
    (tmp_path / "v.json").write_text(
        '{"category": {"0": "PAD", "-3": "neg", "a1": "text", "12": "x,y"},\n "n": {"1": "b"}}')
    rows = {(r.attr, r.key): (r.idx, r.value) for r in logs.scan_vocab(spark, str(tmp_path)).collect()}
    assert rows["category", "-3"] == (-3, "neg") and rows["category", "a1"] == (None, "text")
    assert rows["category", "12"] == (12, "x,y") and rows["n", "1"] == (1, "b")


def test_inverse_vocab_last_position_wins(spark):
    entries = spark.createDataFrame([(0, 4, "a"), (1, 9, "b"), (2, 7, "a")], "pos int, idx int, value string")
    assert dict(map(tuple, attach.inverse_vocab(entries).collect())) == {"a": 7, "b": 9}


def test_type_names_are_null_when_unknown(spark):
    rows = spark.createDataFrame([(0,), (1,), (9,)], "interaction_type int")
    vocab = spark.createDataFrame([("interaction_type", 0, "u"), ("interaction_type", 1, "s")],
                                  "attr string, idx int, value string")
    got = dict(attach.interaction_type_name(rows, vocab).select("interaction_type", "type_name").collect())
    assert got == {0: "u", 1: "s", 9: None}


def test_long_target_lists_are_refused(spark):
    users = spark.range(2).select(F.col("id").alias("row_idx"))
    with pytest.raises(ValueError, match="topk_targets"):
        attach.users_x_items(users, spark.range(10_001).select(F.col("id").alias("item_id")))


def test_topk_targets_takes_lists_of_any_length(spark):
    users = vectors(spark, {0: [1.0]}).withColumnRenamed("id", "row_idx")
    targets = spark.range(3, 10_013).select(F.col("id").cast("int").alias("item_id"), F.array(F.col("id").cast("double")).alias("vec"))
    assert _col(recommend.topk_targets(users, targets, 2).orderBy("rank"), "item_id") == [10_012, 10_011]


def test_dense_attributes(spark):
    df = spark.createDataFrame([([0, 1, 2, 7],)], "category array<int>")
    assert list(map(tuple, logs.item_attr_from_dense(df).collect())) == [(0, 0), (1, 1), (2, 2), (3, 7)]


# ---- scoring

def test_score_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "x array<double>, y array<double>")
    r = df.select(SCORES["dot"]("x", "y"), SCORES["l2"]("x", "y"),
                  SCORES["l2"]("x", "y", F.lit(34.0)), SCORES["l2"]("x", "x")).first()
    assert r[0] == 13.0 and r[1] == pytest.approx(-math.sqrt(13)) and r[2] == r[1]
    assert r[3] == pytest.approx(-1e-5)                     # clamped, not zero
    assert set(SCORES) == {"dot", "l2"}


def test_slate_scores_rules(spark):
    steps = spark.createDataFrame(
        [(0, 0, 0, [1, 4, 2, 5, 0], [1.0]), (1, 1, 0, [4, 5, 0, 0, 0], [1.0])],
        "row_idx bigint, user_id bigint, t int, slate array<int>, z array<double>")
    vecs = vectors(spark, {4: [2.0], 5: [40.0]})
    bias = [10.0 + i for i in range(26)]
    got = {(r.row_idx, r.pos): r.score for r in scoring.slate_scores(steps, vecs, bias, -3.0).collect()}
    assert got[0, 0] == 14.0                                # bias of length 4
    assert got[0, 1] == 6.0                                 # |mult| * dot
    assert got[0, 2] == -100.0                              # unknown item
    assert got[0, 3] == 20.0                                # clamped
    assert got[1, 0] == 0.0                                 # a real item at position 0
    assert (0, 4) not in got and got[1, 1] == 20.0


def test_softmax_sums_to_one_and_loglik(spark):
    rows = [(0, 0, 0, p, s, 1, "train") for p, s in enumerate((1.0, 2.0, -100.0))]
    scores = spark.createDataFrame(
        rows, "row_idx bigint, user_id bigint, t int, pos int, score double, click_idx int, phase string")
    probs = {r.pos: r.prob for r in scoring.slate_softmax(scores).collect()}
    assert sum(probs.values()) == pytest.approx(1.0)
    assert len(scoring.slate_softmax(scores, shown_only=True).collect()) == 2
    ll = scoring.slate_loglik(scores, 0.5).first()
    assert ll.loglik == pytest.approx(math.log(probs[1]) / 0.5)


def test_flat_items_are_squashed(spark):
    v = vectors(spark, {3: [0.5, -2.0]})
    assert scoring.ITEM_MODELS["hier"](v).first().vec == [0.5, -2.0]
    assert scoring.ITEM_MODELS["flat"](v).first().vec == pytest.approx([math.tanh(0.5), math.tanh(-2.0)])


# ---- lists and evaluation

def _recs(spark, table):
    return spark.createDataFrame(
        [(u, i, r) for u, xs in table.items() for r, i in enumerate(xs, 1)],
        "row_idx bigint, item_id int, rank int")


def _test_log(spark, clicks):
    log = make_log(spark, {u: [([1, max(c, 3)], c) for c in cs] for u, cs in clicks.items()})
    return log.withColumn("split", F.lit("test"))


def test_hitrate_drops_items_clicked_before(spark):
    log = _test_log(spark, {0: [5, 6, 7, 8, 9, 5, 6]})
    recs = recommend.rec_lists(_recs(spark, {0: [5, 6]}))
    assert metrics.hitrate(log, recs).first().hitrate == 0.0
    assert metrics.hitrate(log, recs, remove_clicked=False).first().hitrate == 2.0


def test_hitrate_can_exceed_one(spark):
    early = [1] * 5
    log = _test_log(spark, {0: early + [5, 6, 7, 5], 1: early + [8]})
    recs = recommend.rec_lists(_recs(spark, {0: [5, 6, 7], 1: [9]}))
    r = metrics.hitrate(log, recs).first()
    assert (r.hits, r.users, r.hitrate) == (3, 2, 1.5)
    asked = []

    def recommender(users):
        asked.append(sorted(_col(users, "user_id")))
        return _recs(spark, {0: [5, 6, 7], 1: [9]})

    assert metrics.hitrate_of(log, recommender).first().hitrate == 1.5 and asked == [[0, 1]]


def test_hitrate_by_phase_variant(spark):
    log = _test_log(spark, {0: [7] * 5 + [8, 7], 1: [1] * 8}).drop("split").withColumn(
        "mask_type", F.when(F.col("row_idx") == 0, F.array_repeat(F.lit(3), 20)).otherwise(
            F.array_repeat(F.lit(1), 20)))
    recs = recommend.rec_lists(_recs(spark, {0: [7, 8], 1: [9]}))
    got = dict(map(tuple, metrics.hitrate_by_phase(log, recs).collect()))
    assert got == {"test": 1.0, "train": 0.0}               # step 5 itself is not counted


def test_reward_masks(spark):
    rows = [(0, 5, 1.0, 2), (0, 6, 0.0, 2), (1, 5, 0.0, 3), (1, 6, 0.0, 3), (2, 4, 1.0, 1), (2, 5, 1.0, 1)]
    r = spark.createDataFrame(rows, "row_idx bigint, t int, reward double, mask_type int")
    mean = lambda **k: dict(map(tuple, metrics.mean_reward(metrics.reward_by_step(r, **k)).collect()))
    assert mean() == {"valid": 0.5, "test": 0.0, "train": 1.0}
    assert mean(legacy_test_mask=True)["test"] == 0.5


def test_footrule_counts_all_ids(spark):
    a = _recs(spark, {0: [3, 4, 5]}).withColumn("rank", F.col("rank") - 1)
    b = _recs(spark, {0: [5, 4, 3]}).withColumn("rank", F.col("rank") - 1)
    assert metrics.footrule(a, b, F.lit(1), F.lit(6)).first()[0] == pytest.approx(4 / 6)
    short = _recs(spark, {0: [6]}).withColumn("rank", F.col("rank") - 1)
    assert metrics.footrule(a, short, F.lit(1), F.lit(7)).first()[0] == pytest.approx(3 / 7)


def test_topk_footrule_per_split(spark):
    users = spark.createDataFrame([(0, "train"), (1, "train"), (2, "test")], "row_idx bigint, split string")
    a = _recs(spark, {0: [3, 4], 1: [3, 4], 2: [3, 4]})
    b = _recs(spark, {0: [3, 4], 1: [5, 6], 2: [4, 3]})
    got = dict(map(tuple, metrics.topk_footrule(a, b, users, 2).collect()))
    assert got == {"train": pytest.approx(0.5), "test": pytest.approx(2 / 6)}


def test_rank_from_order(spark):
    ordered = recommend.order_items(spark.createDataFrame([(4, 9), (3, 5), (5, 9)], "item_id int, n int"),
                                    F.desc("n"), F.asc("item_id"))
    ids = spark.range(7).select(F.col("id").cast("int").alias("item_id"))
    got = dict(map(tuple, recommend.rank_from_order(ordered, ids).collect()))
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0, 5: 1, 6: 0}


def test_thompson_reads_rank_by_rank(spark, monkeypatch):
    ranked = spark.createDataFrame(
        [(d, 0, 0, i, 0.0, r) for d, xs in enumerate(([3, 4, 5], [6, 3, 4], [3, 7, 8]))
         for r, i in enumerate(xs, 1)],
        "draw int, row_idx bigint, t int, item_id int, score double, rank int")
    monkeypatch.setattr(recommend, "topk_states", lambda *a, **k: ranked)
    post = vectors(spark, {3: [1.0]}).withColumn("scale", F.col("vec"))
    users = vectors(spark, {0: [1.0]}).withColumnRenamed("id", "row_idx")
    got = recommend.topk_inslate_thompson(users, post, 3).orderBy("rank").collect()
    assert [r.item_id for r in got] == [3, 6, 4]


def test_reserved_ids_only_compete_when_asked(spark):
    users = vectors(spark, {0: [1.0]}).withColumnRenamed("id", "row_idx")
    vecs = vectors(spark, {1: [9.0], 3: [1.0], 4: [2.0]})
    assert _col(recommend.topk_states(users, vecs, 2).orderBy("rank"), "item_id") == [4, 3]
    assert _col(recommend.topk_states(users, vecs, 2, reserved=True).orderBy("rank"), "item_id") == [1, 4]
    assert FIRST_REAL == 3

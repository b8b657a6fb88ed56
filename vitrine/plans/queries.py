"""Registered queries: operators applied to the slate log of an input folder.

Every query takes (spark, sf_dir).  Result columns are scalars; arrays and
vectors are printed as text, vectors in millionths.
"""

import hashlib
import math

from pyspark.sql import functions as F

from vitrine.functions.hashing import uniform
from vitrine.functions.vectors import mean_vectors, total
from vitrine.operators import (
    attach, metrics, profile, recommend, reshape, sampling, scoring, split, stats, train, validate,
)
from vitrine.schema import FIRST_REAL, MAX_SLATE, MASK_CODE, PHASES, T_SPLIT
from vitrine.sources import log as logs
from vitrine.sources.orders import slate_tables, write_tables
from vitrine.sources.shared import cut_lineage, new_path

DIM = 64
MF_DIM = 9
MF_EPOCHS = 3
MF_RATE = 0.01
TOP_K = 20
BATCH = 1024
GAMMA = 0.8
SOFTMAX_MULT = 2.0
BIAS = [-1.0 + 0.1 * i for i in range(MAX_SLATE + 1)]
PRIOR_SCALES = {"groupvec": 0.2, "groupscale": 0.2, "bias": 1.0, "user": 1.0}
TEMPERATURE = 0.5
PRIOR_TEMPERATURE = 2.0
DECAY, AMORT_SCALE = 0.7, 0.2
MIN_VIEWS = 20
# States of steps that are on disk at once where those of two models are scored: users are taken part by part.
PART_BYTES = 12 << 30

QUERIES = {}


def query(fn):
    """Register ``fn(tables)`` under its name."""
    def run(spark, sf_dir):
        return fn(slate_tables(spark, sf_dir))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- printing -------------------------------------------------------------

def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def grid(c):
    return F.array_join(F.transform(c, lambda r: ints(r)), ";")


def millionths(c):
    return F.array_join(F.transform(
        c, lambda x: F.floor(x * 1e6 + 0.5).cast("bigint").cast("string")), ",")


def bits(c):
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")


# ---- shared inputs --------------------------------------------------------

def n_items(t):
    """Stored with the log; dataset_dims is the query that computes it."""
    return t.dims.select("num_items").scalar()


def split_log(t, *columns):
    """Wide log with ``split``; only the named step columns are read."""
    rows = t.log.select("row_idx", "user_id", *(columns or ("click",)))
    return split.split_users_pct(rows, t.users)


def phased(t, *columns):
    """Observed interactions with the phase they belong to."""
    cols = tuple(dict.fromkeys(("click", *columns)))
    return reshape.explode_interactions(split_log(t, *cols), cols).withColumn(
        "phase", split.phase_of_step())


def posterior(t):
    scale = F.array_repeat(F.lit(0.05) + F.lit(0.01) * (F.col("id") % 5), F.size("vec"))
    return t.itemvec.withColumn("scale", scale)


def groups(t):
    """Category means of the item vectors, with a fixed scale per category."""
    cat = t.items.select(F.col("item_id").cast("bigint").alias("id"), "category_id")
    means = mean_vectors(t.itemvec.join(cat, "id"), ["category_id"], F.col("vec"), DIM)
    scale = F.array_repeat(F.lit(0.04) + F.lit(0.01) * (F.col("category_id") % 3), DIM)
    return means.select(F.col("category_id").cast("bigint").alias("id"), "vec", scale.alias("scale"))


def itemvec_hat(t, both=False):
    """Estimated vectors: the mean of each item's and the next item's, cyclic; with ``both``, behind the true one."""
    m = t.itemvec.agg(F.count("*")).scalar()
    nxt = t.itemvec.select(
        (FIRST_REAL + (F.col("id") - FIRST_REAL + m - 1) % m).alias("id"),
        F.col("vec").alias("nxt"))
    mean = F.zip_with("vec", "nxt", lambda a, b: (a + b) * 0.5)
    return t.itemvec.join(nxt, "id").select("id", (F.concat("vec", mean) if both else mean).alias("vec"))


def started(t, itemvec=None, log=None, keep=()):
    """Click vectors and start vectors of every user."""
    vecs = itemvec if itemvec is not None else t.itemvec
    clicked = profile.click_vectors(log if log is not None else t.log, vecs, keep)
    return profile.profile_start(clicked, "normal", DIM, t.uservec)


def linear(t, itemvec=None, log=None, keep=()):
    return profile.fold_linear(started(t, itemvec, log, keep), GAMMA)


def shown_scores(t, observed=False, compare=False, phase=None):
    """Slate scores of all steps, or of the observed ones with their phase, or of one ``phase`` of these.

    With ``compare`` the estimated vectors are scored in the same pass: both vectors of an
    item are folded as one, and users are taken in parts, whose states are deleted once
    they are scored.
    """
    log = split_log(t, *SHOWN) if observed else t.log
    if not compare:
        return _shown_scores(t, log, t.itemvec, t.uservec, observed, phase=phase)
    vecs = cut_lineage(itemvec_hat(t, both=True))
    users = t.uservec.withColumn("vec", F.concat("vec", "vec"))
    steps = log.agg(F.sum(F.size(F.array_remove("click", 0)))).first()[0] or 0
    parts, out = math.ceil(steps * 2 * DIM * 8 / PART_BYTES), None
    if parts < 2:
        return _shown_scores(t, log, vecs, users, observed, True)
    for p in range(parts):
        own = log.where(F.pmod(F.xxhash64("row_idx"), F.lit(parts)) == p)
        scores = _shown_scores(t, own, vecs, users, observed, True)
        scores = scores if hasattr(scores, "_cut_path") else cut_lineage(scores)
        out = scores if out is None else out.unionByName(scores)
    return out


SHOWN = ("click", "click_idx", "slate")


def _shown_scores(t, log, vecs, users, observed, compare=False, phase=None):
    """Of the users of ``log``."""
    cols, models = SHOWN, scoring.ONE_MODEL
    if compare:
        models = {**models, "score_hat": ("z_hat", "vec_hat")}
    clicked = profile.click_vectors(log, vecs, (*cols, *(["split"] if observed else [])))
    folded = profile.fold_linear(profile.profile_start(clicked, "normal", DIM, users), GAMMA)
    steps = profile.steps_with_state(folded, cols)
    if compare:
        halves = lambda c: (F.slice(c, 1, DIM), F.slice(c, DIM + 1, DIM))
        steps = steps.withColumns(dict(zip(("z", "z_hat"), halves("z"))))
        vecs = vecs.select("id", *[h.alias(n) for n, h in zip(("vec", "vec_hat"), halves("vec"))])
    if observed:
        steps = reshape.observed_step_filter(steps).withColumn("phase", split.phase_of_step())
    if phase:
        steps = steps.where(F.col("phase") == phase)
    return scoring.slate_scores(
        steps.drop("click", "split"), vecs, BIAS, SOFTMAX_MULT, models=models)


def top_items(t, users=None, itemvec=None, dist="dot", k=TOP_K):
    return recommend.topk_items(
        users if users is not None else t.uservec,
        itemvec if itemvec is not None else t.itemvec, k, dist)


def views(t):
    return stats.item_view_counts(t.log, n_items(t))


def most_viewed(t, k):
    return views(t).where(F.col("item_id") >= FIRST_REAL).orderBy(
        F.desc("views"), "item_id").limit(k).select("item_id")


def with_user(rows, t):
    return rows.join(t.users, "row_idx")


def batches(t):
    return split.batch_assign(split.split_users_pct(t.users, t.users), BATCH)


def mask_types(t, *columns):
    return split.mask_type(split_log(t, *(columns or ("click",))))


def mf_steps(t):
    """Real clicks with negatives."""
    steps = phased(t).where(F.col("click") >= FIRST_REAL)
    return sampling.sample_candidates(steps, n_items(t), 4)


def metric_rows(t):
    """Mean click index as a metrics log: epochs and batches by user id."""
    return phased(t, "click_idx").groupBy(
        (F.col("user_id") % 5).cast("int").alias("epoch"), "phase",
        F.floor(F.col("user_id") / 100).alias("batch_id"),
    ).agg(F.avg("click_idx").alias("value")).withColumn("name", F.lit("click_idx"))


def hashed_matrix(tag, rows, cols):
    """Small weight matrix: entry (r, c) is U(tag:r:c) - 0.5."""
    def entry(r, c):
        digest = hashlib.md5(f"{tag}:{r}:{c}".encode()).hexdigest()
        return float(int(digest[:15], 16)) / 2.0**60 - 0.5

    return [[entry(r, c) for c in range(cols)] for r in range(rows)]


def gru_weights(dim=DIM):
    """Weights shrink with the width, so that gates don't saturate."""
    return {w: [[x / dim**0.5 for x in row] for row in hashed_matrix(f"gru:{w}", dim, dim)]
            for w in ("z", "ir", "id", "in", "hr", "hd", "hn")}


# ---- scans, sinks ---------------------------------------------------------

@query
def scan_slate_log(t):
    return t.log.select(
        "row_idx", "user_id", ints("click").alias("click"), ints("click_idx").alias("click_idx"),
        ints("slate_lengths").alias("slate_lengths"),
        ints("interaction_type").alias("interaction_type"), grid("slate").alias("slate"))


@query
def scan_vocab(t):
    return t.vocab.select("attr", "idx", "value")


@query
def scan_item_attr(t):
    return t.items


@query
def narrow_ids(t):
    wide = t.log.withColumn("click", F.col("click").cast("array<bigint>")).withColumn(
        "slate", F.col("slate").cast("array<array<bigint>>"))
    return logs.narrow_ids(wide).select(
        "row_idx", ints("click").alias("click"), grid("slate").alias("slate"),
        F.expr("typeof(click)").alias("click_type"))


@query
def sink_phase_batches(t):
    path = new_path(t.spark, "batches")
    logs.sink_phase_batches(t.log.select("row_idx", "click", "slate").join(batches(t), "row_idx"), path)
    return logs.phase_batch_counts(t.spark.read.parquet(path))


@query
def sink_model_tables(t):
    path = new_path(t.spark, "model")
    logs.sink_model_tables({"itemvec": t.itemvec, "uservec": t.uservec.select("id", "vec")}, path)
    loaded = logs.load_model_tables(t.spark, path, ("itemvec", "uservec"))
    parts = [df.select(F.lit(n).alias("name"), "id", F.size("vec").alias("dim"),
                       r6(total("vec")).alias("vec_sum")) for n, df in loaded.items()]
    return parts[0].unionByName(parts[1])


@query
def sink_metrics(t):
    path = new_path(t.spark, "metrics")
    rows = metric_rows(t)
    logs.sink_metrics(rows.where("phase = 'train'"), path)
    logs.sink_metrics(rows.where("phase <> 'train'"), path)
    return logs.scan_metrics(t.spark, path).select(
        "epoch", "phase", "batch_id", "name", r6("value").alias("value"))


# ---- validation, dimensions -----------------------------------------------

@query
def validate_log(t):
    return validate.validate_log(t.log)


@query
def dataset_dims(t):
    return validate.dataset_dims(t.log, t.vocab)


@query
def num_groups(t):
    return validate.num_groups(t.items)


@query
def checksum_columns(t):
    masked = mask_types(t, *[c for c in logs.LOG.names[2:]])
    return validate.checksum_columns(masked).select("column", r6("mean").alias("mean"))


@query
def checksum_batch(t):
    return validate.checksum_batch(t.log, batches(t))


# ---- projections, filters, reshaping --------------------------------------

@query
def explode_interactions(t):
    return reshape.explode_interactions(
        t.log, ("click", "click_idx", "slate_lengths", "interaction_type")).drop("row_idx")


@query
def explode_exposures(t):
    return reshape.explode_exposures(t.log).select("user_id", "t", "pos", "item_id")


@query
def pack_interactions(t):
    shown = reshape.explode_exposures(t.log)
    rest = reshape.explode_interactions(
        t.log, ("click", "click_idx", "slate_lengths", "interaction_type"))
    rows = rest.join(reshape.pack_slates(shown), ["row_idx", "user_id", "t"])
    return reshape.pack_interactions(rows).select(
        "row_idx", "user_id", ints("click").alias("click"), ints("click_idx").alias("click_idx"),
        ints("slate_lengths").alias("slate_lengths"),
        ints("interaction_type").alias("interaction_type"), grid("slate").alias("slate"))


@query
def interaction_lookup(t):
    return reshape.interaction_lookup(t.log, 3).withColumn("slate", ints("slate"))


@query
def limit_users(t):
    return reshape.limit_users(t.log.select("row_idx", "user_id", "click"), 1000).withColumn(
        "click", ints("click"))


@query
def slate_length(t):
    rows = reshape.explode_interactions(t.log, ("slate",))
    return rows.select("user_id", "t", reshape.slate_length("slate").alias("slate_length"))


@query
def click_position(t):
    rows = reshape.explode_interactions(t.log, ("slate", "click"))
    return rows.select("user_id", "t", reshape.click_position("slate", F.col("click")).alias("click_idx"))


@query
def real_item_filter(t):
    return reshape.real_item_filter(reshape.explode_exposures(t.log)).select(
        "user_id", "t", "pos", "item_id")


@query
def observed_step_filter(t):
    return reshape.observed_step_filter(phased(t)).select("phase", "user_id", "t", "click")


@query
def phase_clicks(t):
    return reshape.phase_clicks(split.phase_mask(split_log(t))).select(
        "phase", "user_id", ints("clicks").alias("clicks"))


@query
def history_cut(t):
    return reshape.history_cut(t.log).select(
        "row_idx", "user_id", ints("click").alias("click"), ints("click_idx").alias("click_idx"),
        ints("slate_lengths").alias("slate_lengths"),
        ints("interaction_type").alias("interaction_type"), grid("slate").alias("slate"))


@query
def left_pad_history(t):
    seen = F.filter("click", lambda x: x != 0)
    return t.log.select("row_idx", ints(reshape.left_pad_history(seen, 10)).alias("history"))


@query
def collapse_item_group(t):
    return reshape.collapse_item_group(t.items)


# ---- joins ----------------------------------------------------------------

@query
def item_category_name(t):
    rows = reshape.explode_interactions(t.log, ("click",))
    return attach.item_category_name(rows, t.items, t.vocab).select(
        "user_id", "t", "click", "category_name")


@query
def interaction_type_name(t):
    rows = reshape.explode_interactions(t.log, ("interaction_type",))
    return attach.interaction_type_name(rows, t.vocab).select(
        "user_id", "t", "interaction_type", "type_name")


@query
def inverse_vocab_lookup(t):
    vertical = F.split("value", ",")[0]
    cats = t.vocab.where("attr = 'category'").select("idx", vertical.alias("value"))
    entries = cats.withColumn("pos", F.col("idx"))
    rows = t.items.join(cats.select(F.col("idx").alias("category_id"),
                                    F.col("value").alias("vertical")), "category_id")
    return attach.inverse_vocab_lookup(rows, entries, "vertical").select("item_id", "vertical", "idx")


@query
def gather_item_vectors(t):
    rows = reshape.real_item_filter(reshape.explode_exposures(t.log))
    seen = attach.gather_item_vectors(rows, t.itemvec, spread=("row_idx", "t", "pos"))
    return seen.select("user_id", "t", "pos", "item_id", r6(total("vec")).alias("vec_sum"))


@query
def gather_user_vectors(t):
    rows = reshape.explode_interactions(t.log, ("click",))
    seen = attach.gather_user_vectors(rows, t.uservec)
    return seen.select("user_id", "t", "click", r6(total("vec")).alias("vec_sum"))


@query
def items_left_counts(t):
    real = reshape.explode_interactions(t.log, ("click",)).where(F.col("click") >= FIRST_REAL)
    counts = real.groupBy(F.col("click").alias("item_id")).agg(F.count("*").alias("n"))
    return stats.items_left_counts(counts, n_items(t))


@query
def semi_recommended(t):
    clicks = reshape.explode_interactions(t.log, ("click",)).where(
        (F.col("t") >= T_SPLIT) & (F.col("click") >= FIRST_REAL))
    hits = attach.semi_recommended(
        top_items(t), clicks.select("row_idx", F.col("click").alias("item_id")))
    return with_user(hits, t).select("user_id", "item_id", "rank")


@query
def anti_already_clicked(t):
    clicks = reshape.explode_interactions(t.log, ("click",)).where(F.col("t") < T_SPLIT)
    kept = attach.anti_already_clicked(
        top_items(t), clicks.select("row_idx", F.col("click").alias("item_id")))
    return with_user(kept, t).select("user_id", "item_id", "rank")


@query
def users_x_items(t):
    return attach.users_x_items(t.users, most_viewed(t, 5)).select("user_id", "item_id")


# ---- splits, batches ------------------------------------------------------

@query
def split_users_pct(t):
    return split.split_users_pct(t.users, t.users).select("row_idx", "user_id", "split")


@query
def split_users_ratio(t):
    return split.split_users_ratio(t.users, t.users).select("row_idx", "user_id", "split")


@query
def phase_mask(t):
    return split.phase_mask(split_log(t)).select(
        "phase", "user_id", bits("phase_mask").alias("phase_mask"))


@query
def mask_type(t):
    return mask_types(t).select("user_id", bits("mask_type").alias("mask_type"))


@query
def phase_mask_from_type(t):
    return split.phase_mask_from_type(mask_types(t)).select(
        "phase", "user_id", bits("phase_mask").alias("phase_mask"))


@query
def batch_assign(t):
    return split.batch_assign(split.split_users_pct(t.users, t.users), 100).select(
        "phase", "row_idx", "batch_id", "batch_pos")


# ---- sampling -------------------------------------------------------------

@query
def sample_candidates(t):
    steps = reshape.explode_interactions(t.log, ("click",), drop_pad=False)
    return sampling.sample_candidates(steps, n_items(t), 4).select(
        "user_id", "t", ints("allitem").alias("allitem"))


@query
def sample_uniform_slate(t):
    steps = reshape.explode_interactions(t.log, ("click", "slate"), drop_pad=False)
    return sampling.sample_uniform_slate(steps, n_items(t)).select(
        "user_id", "t", ints("slate").alias("slate"), "click_idx")


@query
def random_recommender(t):
    return sampling.random_recommender(t.users, n_items(t), MAX_SLATE - 1).select(
        "user_id", ints("recs").alias("recs"))


@query
def sample_items_labelled(t):
    drawn = sampling.sample_items_labelled(t.items, t.itemvec, t.vocab)
    items = drawn.select(F.lit("item").alias("kind"), F.col("draw"),
                         F.col("item_id").cast("bigint").alias("id"),
                         F.col("category_name").alias("label"),
                         r6(F.coalesce(total("vec"), F.lit(0.0))).alias("vec_sum"))
    users = t.uservec.where(F.col("row_idx") < 1000).select(
        F.lit("user").alias("kind"), F.col("row_idx").alias("draw"), "id",
        F.lit("").alias("label"), r6(total("vec")).alias("vec_sum"))
    return items.unionByName(users)


@query
def posterior_draw(t):
    drawn = sampling.posterior_draw(posterior(t), [0, 1])
    return drawn.select("draw", "id", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", r6("value"))


@query
def sample_click(t):
    """At every user's last observed step."""
    cols = ("click", "slate")
    log = t.log.withColumn("last", F.size(F.array_remove("click", 0)) - 1)
    folded = linear(t, log=log, keep=(*cols, "last"))
    steps = profile.steps_with_state(folded, cols).where(F.col("t") == F.col("last"))
    scores = scoring.slate_scores(
        steps.drop("click", "last"), t.itemvec, BIAS, SOFTMAX_MULT)
    full = t.log.select("row_idx", (F.element_at("click", -1) != 0).alias("click_at_end"))
    return sampling.sample_click(scores).join(full, "row_idx").select(
        "user_id", "t", "pos", "click_at_end")


# ---- aggregations ---------------------------------------------------------

@query
def noclick_ratio(t):
    return stats.noclick_ratio(t.log).select(r6("noclick_ratio").alias("noclick_ratio"))


@query
def avg_slate_length(t):
    return stats.avg_slate_length(t.log).select(r6("avg_slate_length").alias("avg_slate_length"))


@query
def recommendation_ratio(t):
    return stats.recommendation_ratio(t.log).select(
        r6("recommendation_ratio").alias("recommendation_ratio"))


@query
def avg_interactions_per_user(t):
    return stats.avg_interactions_per_user(t.log).select(
        r6("avg_interactions").alias("avg_interactions"))


@query
def item_click_counts(t):
    return stats.item_click_counts(t.log, n_items(t))


@query
def item_view_counts(t):
    return views(t)


def _ctr(t):
    return stats.item_ctr(stats.item_counts(t.log, n_items(t)), min_views=MIN_VIEWS)


@query
def item_ctr(t):
    return _ctr(t).withColumn("ctr", r6("ctr"))


@query
def top_ctr_items(t):
    return stats.top_ctr_items(_ctr(t)).withColumn("ctr", r6("ctr"))


@query
def popularity_histogram(t):
    return stats.popularity_histogram(views(t))


@query
def value_histogram(t):
    mean_scale = F.round(total("scale") / F.size("scale"), 12)
    mean_vec = F.round(total("vec") / F.size("vec"), 12)
    one = stats.value_histogram(posterior(t), mean_scale).withColumn("name", F.lit("scale"))
    two = stats.value_histogram(t.itemvec, mean_vec).withColumn("name", F.lit("vec"))
    return one.unionByName(two)


@query
def category_counts(t):
    return stats.category_counts(t.items)


def _report(t):
    return stats.item_report(views(t), posterior(t), t.items, t.vocab, groups(t))


@query
def item_report(t):
    rows = _report(t)
    return rows.withColumns({c: r6(c) for c in ("mean_scale", "dist_vec", "dist_scale")})


@query
def density_2d(t):
    metric = F.explode(F.array(*[
        F.struct(F.lit(c).alias("y"), F.col(c).alias("value")) for c in ("mean_scale", "dist_vec")]))
    rows = _report(t).select("vertical", "views", metric.alias("m")).select(
        "vertical", "views", "m.y", "m.value")
    return stats.density_2d(rows, F.col("views"), F.col("value"), ("vertical", "y"))


@query
def num_obs(t):
    return stats.num_obs(phased(t))


@query
def phase_epoch_mean(t):
    return stats.phase_epoch_mean(metric_rows(t)).withColumn("value", r6("value"))


@query
def best_epoch(t):
    epochs = stats.phase_epoch_mean(metric_rows(t)).select(
        "epoch", F.concat_ws("/", "phase", "name").alias("key"), "value")
    best = stats.best_epoch(epochs, "valid/click_idx", ("train/click_idx", "valid/click_idx"))
    return best.select("epoch", r6(F.col("`train/click_idx`")).alias("train_value"),
                       r6(F.col("`valid/click_idx`")).alias("valid_value"))


@query
def param_l1(t):
    return stats.param_l1({"itemvec": t.itemvec, "uservec": t.uservec}).withColumn("l1", r6("l1"))


@query
def state_energy(t):
    return stats.state_energy(profile.step_states(linear(t)), DIM).withColumn("energy", r6("energy"))


@query
def state_std(t):
    return stats.state_std(profile.step_states(linear(t)), DIM).withColumn("std", r6("std"))


@query
def user_hits(t):
    clicks = t.log.select("row_idx", F.array_remove(F.slice("click", F.lit(T_SPLIT + 1), F.size("click")), 0).alias("clicks"))
    hits = stats.user_hits(recommend.rec_lists(top_items(t)), clicks)
    return with_user(hits, t).select("user_id", "hits")


# ---- vector scoring, likelihood -------------------------------------------

def _click_scores(t, dist):
    clicks = reshape.explode_interactions(t.log, ("click",)).where(F.col("click") >= FIRST_REAL)
    return scoring.score_clicks(clicks, t.uservec, t.itemvec, dist).select(
        "user_id", "t", "click", r6("score").alias("score"))


@query
def score_dot(t):
    return _click_scores(t, "dot")


@query
def score_l2(t):
    return _click_scores(t, "l2")


@query
def score_targets(t):
    rows = attach.score_targets(t.uservec, t.itemvec, most_viewed(t, 10))
    return rows.select(F.col("id").alias("user_id"), "item_id", r6("score").alias("score"))


@query
def slate_scores(t):
    return shown_scores(t).select("user_id", "t", "pos", "item_id", r6("score").alias("score"))


@query
def slate_softmax(t):
    return scoring.slate_softmax(shown_scores(t)).select(
        "user_id", "t", "pos", r6("prob").alias("prob"))


@query
def slate_loglik(t):
    raw = scoring.slate_loglik(shown_scores(t, observed=True))
    return raw.select("phase", r6("loglik").alias("loglik"),
                      r6(F.col("loglik") / TEMPERATURE).alias("tempered"))


def _mf_logliks(t, *extra):
    return scoring.mf_step_loglik(mf_steps(t), t.uservec, t.itemvec, extra)


@query
def mf_sampled_loglik(t):
    return scoring.mf_sampled_loglik(_mf_logliks(t, "phase")).withColumn("loglik", r6("loglik"))


@query
def mf_scaled_loss(t):
    members = split.batch_assign(split.split_users_pct(t.users, t.users), 100)
    n_users = t.dims.select("num_users").scalar()
    return scoring.mf_scaled_loss(_mf_logliks(t), members, T_SPLIT, n_users).withColumn("loss", F.round("loss", 4))


@query
def prob_mae(t):
    scores = shown_scores(t, observed=True, compare=True)
    return scoring.prob_mae(scores).withColumn("prob_mae", r6("prob_mae"))


def _priors(t):
    return scoring.hier_log_prior(t.itemvec, t.items, groups(t), t.uservec, BIAS, PRIOR_SCALES)


@query
def hier_log_prior(t):
    return _priors(t).withColumn("log_prior", F.round("log_prior", 4))


@query
def elbo_terms(t):
    loglik = scoring.slate_loglik(shown_scores(t, observed=True, phase="train"), TEMPERATURE)
    prior = _priors(t).agg((F.sum("log_prior") / PRIOR_TEMPERATURE).alias("log_prior"))
    log_q = scoring.posterior_entropy_term(posterior(t))
    rows = scoring.elbo_terms(loglik, prior, log_q, TEMPERATURE, PRIOR_TEMPERATURE)
    return rows.select(*[F.round(c, 4).alias(c) for c in ("loglik", "kl", "elbo")])


@query
def group_distance(t):
    return scoring.group_distance(posterior(t), t.items, groups(t)).withColumns(
        {c: r6(c) for c in ("dist_vec", "dist_scale")})


# ---- user profiles --------------------------------------------------------

def _states(folded):
    return profile.step_states(folded).select("user_id", "t", millionths("vec").alias("vec"))


@query
def profile_linear(t):
    return _states(linear(t))


@query
def profile_markov(t):
    return _states(profile.fold_markov(profile.click_vectors(t.log, t.itemvec), DIM))


@query
def profile_gru(t):
    return _states(profile.fold_gru(started(t), gru_weights()))


@query
def profile_linear_gru(t):
    return _states(profile.fold_linear_gru(started(t), GAMMA, gru_weights()))


@query
def profile_start(t):
    matrix = hashed_matrix("start", DIM, DIM)
    out = None
    for kind in ("zero", "normal", "compact_normal"):
        rows = profile.profile_start(t.users, kind, DIM, t.uservec, matrix).select(
            "user_id", F.lit(kind).alias("kind"), millionths("h0").alias("h0"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def amortized_start(t):
    rows = profile.amortized_start(mask_types(t), t.itemvec, DIM, DECAY, AMORT_SCALE)
    return rows.select("user_id", millionths("vec").alias("mean"), millionths("scale").alias("scale"))


# ---- top-k ----------------------------------------------------------------

@query
def topk_items(t):
    return with_user(top_items(t), t).select(
        "user_id", "item_id", "rank", r6("score").alias("score"))


@query
def topk_targets(t):
    """The best of a list of targets, which may have any length."""
    targets = most_viewed(t, 500).join(t.itemvec.select(F.col("id").cast("int").alias("item_id"), "vec"), "item_id")
    return with_user(recommend.topk_targets(t.uservec, targets, TOP_K), t).select(
        "user_id", "item_id", "rank", r6("score").alias("score"))


@query
def topk_at_step(t):
    states = profile.state_at(linear(t), T_SPLIT)
    ranked = recommend.topk_states(states, t.itemvec, TOP_K)
    return with_user(ranked, t).select("user_id", "item_id", "rank", r6("score").alias("score"))


@query
def topk_over_time(t):
    ranked = recommend.topk_states(profile.distinct_states(linear(t)), t.itemvec, 5, "l2")
    return with_user(ranked, t).select("user_id", "t", "item_id", "rank", r6("score").alias("score"))


@query
def topk_inslate_thompson(t):
    k = 5

    def follow(drawn):
        starts = t.uservec.withColumn("vec", F.flatten(F.array_repeat("vec", k)))
        clicked = profile.click_vectors(t.log, drawn)
        return profile.state_at(profile.fold_linear(profile.profile_start(clicked, "normal", DIM, starts), GAMMA))

    ranked = recommend.topk_inslate_thompson(follow, posterior(t), k)
    return with_user(ranked, t).select("user_id", "item_id", "rank")


@query
def rank_from_order(t):
    seen = views(t)
    real = seen.where(F.col("item_id") >= FIRST_REAL)
    ordered = recommend.order_items(real, F.desc("views"), F.asc("item_id"))
    return recommend.rank_from_order(ordered, seen.select("item_id"))


@query
def category_report(t):
    reserved = t.items.where(F.col("item_id") < FIRST_REAL).select(
        F.col("item_id").cast("bigint").alias("id"), F.array_repeat(F.lit(0.0), DIM).alias("vec"))
    states = profile.distinct_states(linear(t), upto=9)
    ranked = recommend.topk_states(states, t.itemvec.unionByName(reserved), 2, reserved=True)
    return recommend.category_report(t.log, ranked, t.items, t.vocab)


@query
def recs_in_external_list(t):
    rows = recommend.recs_in_external_list(top_items(t), top_items(t, dist="l2"))
    return with_user(rows, t).select("user_id", "n")


# ---- evaluation -----------------------------------------------------------

@query
def hitrate(t):
    def best(users):
        return top_items(t, t.uservec.join(users, "row_idx", "left_semi"))

    return metrics.hitrate_of(split_log(t), best).withColumn("hitrate", r6("hitrate"))


@query
def hitrate_by_phase(t):
    states = profile.state_at(linear(t), T_SPLIT)
    recs = recommend.rec_lists(recommend.topk_states(states, t.itemvec, TOP_K))
    return metrics.hitrate_by_phase(mask_types(t), recs).withColumn("hitrate", r6("hitrate"))


def _rewards(t):
    rows = reshape.explode_interactions(
        mask_types(t).withColumn("interaction_type", F.col("mask_type")),
        ("click", "interaction_type"))
    return rows.select("row_idx", "t", F.col("interaction_type").alias("mask_type"),
                       (F.col("click") >= FIRST_REAL).cast("double").alias("reward"))


@query
def reward_by_step(t):
    steps = metrics.reward_by_step(_rewards(t))
    every = metrics.mean_reward(steps).withColumn("t", F.lit(-1))
    return steps.unionByName(every).withColumn("reward", r6("reward"))


@query
def footrule(t):
    """Top-k lists of the true and the estimated model on each user's last state, per phase."""
    def ranks(vecs):
        return recommend.topk_states(profile.state_at(linear(t, vecs)), vecs, TOP_K)

    users = split.split_users_pct(t.users, t.users)
    distance = metrics.topk_footrule(ranks(t.itemvec), ranks(itemvec_hat(t)), users, TOP_K)
    return distance.select(F.col("split").alias("phase"), r6("footrule").alias("footrule"))


# ---- model fitting --------------------------------------------------------

def _mf_params(t):
    users = train.mf_init(t.users.select(F.col("user_id").alias("id"), "row_idx"), MF_DIM, "user")
    items = train.mf_init(t.itemvec.select("id"), MF_DIM, "item")
    return users, items


@query
def mf_init(t):
    users, items = _mf_params(t)
    rows = users.select(F.lit("user").alias("name"), "id", "vec").unionByName(
        items.select(F.lit("item").alias("name"), "id", "vec"))
    return rows.withColumn("vec", millionths("vec"))


@query
def mf_gradient(t):
    users, items = _mf_params(t)
    steps = mf_steps(t).where("phase = 'train'")
    pulls = train.mf_pulls(train.mf_rows(steps, users, items), MF_DIM)
    du, dv = train.mf_gradient(pulls, MF_DIM)
    rows = du.select(F.lit("user").alias("name"), "id", "vec").unionByName(
        dv.select(F.lit("item").alias("name"), "id", "vec"))
    return rows.withColumn("vec", millionths("vec"))


@query
def mf_fit(t):
    steps = phased(t).where(F.col("click") >= FIRST_REAL)
    users = t.users.select(F.col("user_id").alias("id"))
    _, _, epochs = train.mf_fit(steps, users, t.itemvec.select("id"), n_items(t), MF_DIM,
                                epochs=MF_EPOCHS, lr=MF_RATE)
    return epochs.withColumns({c: F.round(c, 4) for c in ("train_loglik", "valid_loglik")})

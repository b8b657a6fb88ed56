"""Matrix factorization with a categorical loss over sampled candidates."""

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.hashing import uniform
from vitrine.functions.vectors import sum_vectors
from vitrine.operators.sampling import sample_candidates
from vitrine.operators.scoring import mf_candidates, with_candidate_probs
from vitrine.sources.shared import cut_lineage, discard, shuffles_removed

# Start range, and the optimiser's usual constants.
INIT_RANGE = 0.05
BETA1, BETA2, EPS, WEIGHT_DECAY = 0.9, 0.999, 1e-8, 0.01


def mf_init(ids, dim: int, table: str, seed: int = 1) -> DataFrame:
    """(id, …, vec): entries uniform in [-0.05, 0.05], reproducible per id."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (
        uniform("init", seed, table, F.col("id"), d) * (2 * INIT_RANGE) - INIT_RANGE))
    return ids.withColumn("vec", vec)


def mf_rows(steps, uservec, itemvec) -> DataFrame:
    """Steps with user vector, candidates, probabilities and loglik."""
    return with_candidate_probs(mf_candidates(steps, uservec, itemvec))


def mf_pulls(rows, dim: int) -> DataFrame:
    """(user_id, z, dz, pulled, loglik) per step: what a step adds to the gradient.

    The user moves by ``dz``, towards the click and away from the expected
    candidate.  Each candidate of ``pulled`` moves along z by q = (1 if it is the
    click) - p, repeated candidates each on their own.
    """
    rows = rows.withColumn("q", F.transform("p", lambda p, c: F.when(
        c == 0, F.lit(1.0)).otherwise(F.lit(0.0)) - p))
    dz = F.aggregate(
        F.zip_with("cands", "q", lambda c, q: F.transform(c["vec"], lambda v: v * q)),
        F.array_repeat(F.lit(0.0), dim),
        lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    pulled = F.zip_with("cands", "q", lambda c, q: F.struct(
        c["item_id"].alias("item_id"), q.alias("q")))
    return rows.select("user_id", "z", dz.alias("dz"), pulled.alias("pulled"), "loglik")


def mf_gradient(pulls, dim: int):
    """Gradient of the summed loglik: (users (id, vec), items (id, vec)).

    Sums are formed per element, so hot items collapse before the shuffle.
    """
    users = sum_vectors(pulls.withColumnRenamed("user_id", "id"), ["id"], F.col("dz"), dim)
    each = pulls.select("z", F.explode("pulled").alias("e"))
    # the weight rides along; the product is formed inside the partial sums
    parts = [F.sum(F.get("z", F.lit(i)) * F.col("e.q")) for i in range(dim)]
    items = each.groupBy(F.col("e.item_id").cast("bigint").alias("id")).agg(
        F.array(*parts).alias("vec"))
    return users, items


def _adamw(params, grads, step: int, lr: float, factor: float) -> DataFrame:
    """One step on the loss -factor * loglik; rows without gradient decay too."""
    g = F.col("_g")
    rows = params.join(grads.withColumnRenamed("vec", "_raw"), "id", "left").withColumn(
        "_g", F.coalesce(F.transform("_raw", lambda x: x * -factor),
                         F.transform("vec", lambda x: F.lit(0.0))))
    rows = rows.withColumn("m", F.zip_with("m", g, lambda m, x: m * BETA1 + x * (1 - BETA1)))
    rows = rows.withColumn("v", F.zip_with("v", g, lambda v, x: v * BETA2 + x * x * (1 - BETA2)))
    c1, c2 = 1 - BETA1**step, 1 - BETA2**step
    move = F.zip_with("m", "v", lambda m, v: (m / c1) / (F.sqrt(v / c2) + EPS) * lr)
    vec = F.zip_with("vec", move, lambda w, d: w * (1 - lr * WEIGHT_DECAY) - d)
    return rows.withColumn("vec", vec).drop("_g", "_raw")


def _with_moments(params):
    zero = F.transform("vec", lambda x: F.lit(0.0))
    return params.withColumn("m", zero).withColumn("v", zero)


def mf_fit(steps, users, item_ids, num_items: Column, dim=9, epochs=100, negatives=4,
           lr=1e-3, seed=1):
    """(users, items, metrics): full-gradient fit, best epoch by valid loglik.

    ``steps`` are the real clicks (row_idx, user_id, t, click, phase), ``users``
    and ``item_ids`` hold the ids.  Negatives are redrawn every epoch.

    Clicks, parameters and moments are written, the latter two after each step:
    lineage stays short and lost executors never replay earlier epochs.  An epoch
    goes over the train clicks once; its per-step pulls are written for the two
    gradients and the train loglik, so that no shuffle outlives its epoch; that loglik
    is of the parameters the epoch started with.  The driver holds two numbers per epoch.  Once an epoch is written, the
    parameters it started from are deleted unless they are the best: there are never more than
    three copies.
    """
    spark = users.sparkSession
    # ids only: epochs neither split the log nor read it again
    steps = cut_lineage(steps.select("row_idx", "user_id", "t", "click", "phase"))
    train_steps = steps.where(F.col("phase") == "train")
    valid_steps = steps.where(F.col("phase") == "valid")
    u = cut_lineage(_with_moments(mf_init(users, dim, "user", seed)))
    v = cut_lineage(_with_moments(mf_init(item_ids, dim, "item", seed)))
    metrics, best = [], None
    for epoch in range(epochs):
        drawn = sample_candidates(train_steps, num_items, negatives, seed, "train", epoch)
        pulls = cut_lineage(mf_pulls(mf_rows(drawn, u, v), dim))
        du, dv = mf_gradient(pulls, dim)
        train_ll = _sum_loglik(pulls)
        before = (u, v)
        u, v = (cut_lineage(_adamw(p, g, epoch + 1, lr, 1.0)) for p, g in ((u, du), (v, dv)))
        discard(pulls)
        held = sample_candidates(valid_steps, num_items, negatives, seed, "valid", epoch)
        valid_ll = _sum_loglik(mf_rows(held, u, v))
        metrics.append((epoch, train_ll, valid_ll))
        passed = [before]
        if best is None or valid_ll > best[0]:
            passed += [best[1:]] if best and best[1] is not before[0] else []
            best = (valid_ll, u, v)
        for tables in passed:  # the epoch is written, so nothing goes back to these
            if tables[0] is not best[1]:
                discard(tables[0])
                discard(tables[1])
    table = spark.createDataFrame(
        metrics, "epoch int, train_loglik double, valid_loglik double")
    return best[1].select("id", "vec"), best[2].select("id", "vec"), table


def _sum_loglik(rows) -> float:
    total = rows.agg(F.coalesce(F.sum("loglik"), F.lit(0.0)))
    with shuffles_removed(rows.sparkSession):
        return float(total.first()[0])

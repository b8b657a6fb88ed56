"""What is left on disk: shuffles of what was written, states of scored steps, pulls of an epoch."""

import glob
import os
import time

from pyspark.sql import functions as F

from tests.conftest import vectors
from vitrine.functions import joins
from vitrine.operators import scoring, train
from vitrine.plans import queries
from vitrine.sources.shared import CLEANUP, cut_lineage, shared_folder


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {f for f in files.split(",") if "/shuffle_" in f}


def _left(spark, before):
    """Shuffle files that stay; they are removed in the background."""
    for _ in range(100):
        new = _shuffles(spark) - before
        if not new:
            break
        time.sleep(0.1)
    return len(new)


def _cuts(spark):
    return set(glob.glob(os.path.join(shared_folder(spark), "cut-*")))


def test_shuffles_of_written_frames_are_removed(spark):
    was, before = spark.conf.get(CLEANUP), _shuffles(spark)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    written = cut_lineage(grouped)
    assert _left(spark, before) == 0
    assert spark.conf.get(CLEANUP) == was
    assert sorted(written.collect()) == sorted(grouped.collect())


def test_states_are_deleted_once_they_are_scored(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "SLICE_BYTES", 200)
    steps = spark.createDataFrame(
        [(u, u, 0, [1, 3 + u, 2, 0], [1.0, float(u)]) for u in range(6)],
        "row_idx bigint, user_id bigint, t int, slate array<int>, z array<double>")
    before = _cuts(spark)
    scores = scoring.slate_scores(steps, vectors(spark, {3 + i: [0.5, i] for i in range(6)}), [0.25] * 26)
    assert len(_cuts(spark) - before) == 1
    got = {(r.row_idx, r.pos): r.score for r in scores.collect()}
    assert got == {(u, p): s for u in range(6) for p, s in ((0, 0.25), (1, min(20.0, 0.5 + u * u)), (2, -100.0))}


def test_compared_models_in_parts_of_users(tables, monkeypatch):
    want = sorted(map(tuple, queries.shown_scores(tables, observed=True, compare=True).collect()))
    own, seen = queries._shown_scores, []

    def spy(t, log, *rest, **more):
        seen.append({r[0] for r in log.select("row_idx").collect()})
        return own(t, log, *rest, **more)

    monkeypatch.setattr(queries, "_shown_scores", spy)
    steps = tables.log.agg(F.sum(F.size(F.array_remove("click", 0)))).first()[0]
    monkeypatch.setattr(queries, "PART_BYTES", steps * 2 * queries.DIM * 8 // 3 + 1)
    got = queries.shown_scores(tables, observed=True, compare=True)
    assert sorted(map(tuple, got.collect())) == want
    assert len(seen) == 3 and all(seen) and sum(map(len, seen)) == tables.log.count() == len(set().union(*seen))


def test_scores_of_one_phase(tables):
    every = queries.shown_scores(tables, observed=True)
    want = sorted(map(tuple, every.where("phase = 'train'").collect()))
    assert sorted(map(tuple, queries.shown_scores(tables, observed=True, phase="train").collect())) == want
    assert 0 < len(want) < every.count()


def test_no_shuffle_outlives_its_epoch(spark):
    steps = spark.createDataFrame(
        [(u, u, t, 3 + (u + t) % 5, "valid" if t == 3 else "train") for u in range(1000) for t in range(4)],
        "row_idx bigint, user_id bigint, t int, click int, phase string")
    before = _shuffles(spark)
    users, items, _ = train.mf_fit(steps, spark.range(1000), spark.range(3, 8), F.lit(8), dim=2, epochs=2, lr=0.05)
    # only sums of one row per task stay: sizes of tables, the train loglik
    size = lambda: sum(os.path.getsize(f) for f in _shuffles(spark) - before if os.path.exists(f))
    for _ in range(100):
        if size() < 30_000:
            break
        time.sleep(0.1)
    assert size() < 30_000
    assert users.count() == 1000 and items.count() == 5

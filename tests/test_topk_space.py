"""Top-k over several rounds: what is kept on disk, and the screen by the best rough score."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vitrine.operators import recommend
from vitrine.sources.shared import shared_folder


def test_rounds_keep_the_last_lists_only(spark):
    rng = np.random.default_rng(1)
    users = vectors(spark, {i: rng.normal(size=8) for i in range(20)}).withColumnRenamed("id", "row_idx")
    items = vectors(spark, {3 + i: rng.normal(size=8) for i in range(600)})
    files = lambda: set(glob.glob(os.path.join(shared_folder(spark), "cut-*")))
    before = files()
    got = recommend.topk_items(users, items, 4, max_items=100, round_bytes=1)
    assert len(files() - before) == 1  # six rounds; the blocks and the lists of four are deleted
    assert got.where("rank = 1").count() == 20 and got.count() == 80


@pytest.mark.parametrize("dist", ["dot", "l2"])
def test_screen_by_best_rough_score(dist):
    rng = np.random.default_rng(4)
    x, y, k = rng.normal(size=(40, 8)), rng.normal(size=(3000, 8)), 5
    y[1000:1400] = y[7]  # ties at the cut, of larger ids
    y[2500:2600] = np.nan
    space, lists = recommend._Space(), (np.full((40, k), -np.inf), np.full((40, k), recommend._NONE, np.int32))
    xx = recommend._square(x)
    for at in range(0, len(y), 300):
        block = recommend._Block(np.arange(at, at + 300, dtype=np.int32), y[at:at + 300], 1, dist)
        block.low, block.high = [0.0], [100.0]  # no block is skipped, whatever its norms
        block.merge(0, x, xx, np.sqrt(xx), lists, k, space)
    score = sum(x[:, [j]] * y[:, j] for j in range(8))
    if dist == "l2":
        score = -np.sqrt(np.maximum(xx[:, None] - 2.0 * score + recommend._square(y), 1e-10))
    want = np.argsort(np.where(np.isnan(score), np.inf, -score), axis=1, kind="stable")[:, :k]
    assert (lists[1] == want).all()
    assert space.held[np.dtype(np.float32) if np.dtype(np.float32) in space.held else np.float32].size == 40 * 300

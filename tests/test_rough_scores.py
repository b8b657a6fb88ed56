"""Rough scores are single precision; lists are those of exact scores."""

import numpy as np
import pytest

from vitrine.operators import recommend


def _lists(x, y, k, dist):
    scores, ids = np.full((len(x), k), -np.inf), np.full((len(x), k), recommend._NONE, np.int32)
    xx = recommend._square(x)
    for at in range(0, len(y), 100):
        part = slice(at, at + 100)
        block = recommend._Block(np.arange(len(y), dtype=np.int32)[part], y[part], 1, dist)
        block.merge(0, x, xx, np.sqrt(xx), (scores, ids), k)
    return ids


@pytest.mark.parametrize("dist", ["dot", "l2"])
@pytest.mark.parametrize("size", [1.0, 1e-30, 1e12, 1e40])
def test_neighbours_beyond_single_precision(dist, size):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(600, 16)) * size
    y[100:200] = y[0] * (1 + 1e-9 * rng.normal(size=(100, 1)))  # equal in single precision
    y[5], y[300:310] = 0.0, y[1]
    x = np.concatenate([rng.normal(size=(20, 16)) * size, y[:3], np.zeros((1, 16))])
    score = sum(x[:, [j]] * y[:, j] for j in range(16))
    if dist == "l2":
        xx, yy = recommend._square(x)[:, None], recommend._square(y)
        score = -np.sqrt(np.maximum(xx - 2.0 * score + yy, 1e-10))
    want = np.argsort(-score, axis=1, kind="stable")[:, :8]
    assert (_lists(x, y, 8, dist) == want).all()


def test_rough_scores_are_single_precision_in_range():
    x = np.ones((2, 4))
    for size, kind in ((1.0, np.float32), (1e40, np.float64)):
        block = recommend._Block(np.arange(3, dtype=np.int32), np.full((3, 4), size), 1, "dot")
        rough, error = block.rough(0, x, np.sqrt(recommend._square(x)))
        assert rough.dtype == kind and (error > 0).all()

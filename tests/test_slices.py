"""Item vectors too large for one broadcast are looked up slice by slice; wide rows aren't shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import vectors
from vitrine.functions import joins
from vitrine.operators import scoring, stats

RNG = np.random.default_rng(11)
SINGLE = {3 + i: RNG.normal(size=5).astype(np.float32).tolist() for i in range(40)}
DOUBLE = {3 + i: RNG.normal(size=5).tolist() for i in range(40)}


def _small(monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "SLICE_BYTES", 500)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _steps(spark):
    rows = [(u, u + 7, t, [1, 3 + (u * 5 + t) % 44, 4 + t, 2, None, 3 + t, 0, 0], [float(u), 0.1, t / 3, -1.5, 0.7])
            for u in range(6) for t in range(4)]
    rows += [rows[0], (None, None, 0, [5, 3, 4], rows[1][4]), (9, 9, 0, None, rows[2][4]), (9, 9, 1, [1, 3], None)]
    return spark.createDataFrame(rows, "row_idx bigint, user_id bigint, t int, slate array<int>, z array<double>")


@pytest.mark.parametrize("dist", ["dot", "l2"])
@pytest.mark.parametrize("table", [SINGLE, DOUBLE])
def test_slate_scores_by_slices(spark, monkeypatch, dist, table):
    steps, vecs = _steps(spark), vectors(spark, table)
    bias = [0.5 * i for i in range(26)]
    want = _rows(scoring.slate_scores(steps, vecs, bias, -2.0, dist))
    _small(monkeypatch)
    got = scoring.slate_scores(steps, vecs, bias, -2.0, dist)
    assert _rows(got) == want
    assert "Exchange" not in _plan(got)


@pytest.mark.parametrize("table", [SINGLE, DOUBLE])
def test_sampled_loglik_by_slices(spark, monkeypatch, table):
    rows = [(u, u + 7, t, 3 + (u * 7 + t) % 42, [3 + (u + k * t) % 43 for k in range(4)], "train" if t else "valid")
            for u in range(6) for t in range(4)]
    rows += [rows[0], (50, 999, 0, 3, [4, 5, 6, 7], "train")]
    steps = spark.createDataFrame(
        rows, "row_idx bigint, user_id bigint, t int, click int, allitem array<int>, phase string")
    users = vectors(spark, {u + 7: RNG.normal(size=5) for u in range(6)})
    vecs = vectors(spark, table)

    def found():
        df = scoring.mf_step_loglik(steps, users, vecs, ("phase",))
        return df, sorted(map(tuple, df.collect()), key=repr)

    want = found()[1]
    _small(monkeypatch)
    df, got = found()
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-12)
    assert "vec" not in _plan(df)


def test_single_precision_only_where_exact(spark):
    both = vectors(spark, SINGLE).join(vectors(spark, DOUBLE).withColumnRenamed("vec", "other"), "id")
    kept = joins.as_floats(both, ("vec", "other"))
    assert dict(kept.dtypes)["vec"] == "array<float>" and dict(kept.dtypes)["other"] == "array<double>"
    assert _rows(kept.withColumn("vec", F.col("vec").cast("array<double>"))) == _rows(both)


def test_state_std_is_one_pass_of_moments(spark):
    rows = RNG.normal(1e6, 1e-2, size=(500, 3)).tolist()
    states = spark.createDataFrame([(r,) for r in rows] + [(None,), ([1e6],), ([None, 1e6, None],)], "vec array<double>")
    out = stats.state_std(states.repartition(7), 4)
    got = {r["dim"]: r["std"] for r in out.collect()}
    columns = [[r[i] for r in rows] for i in range(3)]
    columns[0].append(1e6)
    columns[1].append(1e6)
    assert got[3] is None
    assert np.allclose([got[i] for i in range(3)], [np.std(c, ddof=1) for c in columns], rtol=1e-6)
    assert "stddev_samp" not in _plan(out)
    one = stats.state_std(spark.createDataFrame([([1.0, 2.0],)], "vec array<double>"), 2)
    assert [r["std"] for r in one.orderBy("dim").collect()] == [None, None]

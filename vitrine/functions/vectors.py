"""Arithmetic on array<double> columns, and the pluggable score functions."""

import json

from pyspark.sql import Column, functions as F


def total(xs) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(x, y) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_norm(x) -> Column:
    return total(F.transform(x, lambda a: a * a))


def distance(x, y) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def blend(x, y, wx, wy) -> Column:
    return F.zip_with(x, y, lambda a, b: wx * a + wy * b)


def scaled(x, w) -> Column:
    return F.transform(x, lambda a: a * w)


def let(value, body) -> Column:
    """``body`` of a value computed once per row, for use inside lambdas.

    Spark may inline a column used once into a lambda and then compute it for
    every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def matvec(rows, x) -> Column:
    """Product of a Python matrix (list of rows) with a vector column.

    The matrix is one constant of the plan, whatever its size.
    """
    text = json.dumps([[float(w) for w in row] for row in rows])
    return F.transform(F.from_json(F.lit(text), "array<array<double>>"), lambda row: dot(row, x))


def as_double(x) -> Column:
    return F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>")


def score_dot(x, y, ynorm=None) -> Column:
    return dot(x, y)


def score_l2(x, y, ynorm=None) -> Column:
    """Negative Euclidean distance; ``ynorm`` may hold a stored squared norm."""
    yy = squared_norm(y) if ynorm is None else ynorm
    gap = squared_norm(x) - 2.0 * dot(x, y) + yy
    return -F.sqrt(F.greatest(gap, F.lit(1e-10)))


SCORES = {"dot": score_dot, "l2": score_l2}


def sum_vectors(rows, keys, vec, dim, name="vec"):
    """Element-wise sum of equally long vectors per key.

    One partial sum per element, so hot keys collapse before the shuffle.
    """
    parts = [F.sum(F.get(vec, F.lit(i))) for i in range(dim)]
    return rows.groupBy(*keys).agg(F.array(*parts).alias(name))


def mean_vectors(rows, keys, vec, dim, name="vec"):
    parts = [F.avg(F.get(vec, F.lit(i))) for i in range(dim)]
    return rows.groupBy(*keys).agg(F.array(*parts).alias(name))

"""Vector distances as built-in higher-order array expressions (no UDF).

Arithmetic is done in double precision; element order is fixed, so the result is
deterministic across runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum_pairs(a, b, f) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return _sum_pairs(a, b, lambda x, y: x * y)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def l2_distance(a, b) -> Column:
    return F.sqrt(_sum_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a, b) -> Column:
    return _sum_pairs(a, b, lambda x, y: F.abs(x - y))


def inner_product(a, b) -> Column:
    return dot(a, b)


CHAIN = 64  # longest sum written out as one expression


def sparse_dot(vec, q: list[float]) -> Column:
    """Dot product with a query vector that is zero in most places, over its non-zero entries only.

    Few of them become one generated expression; a long text has hundreds, too deep a sum for the
    analyser and too large a method for the compiler, so those are folded over two constant arrays.
    Both add in the order of the entries, so they give the same number."""
    v = _c(vec)
    at = [i for i, x in enumerate(q) if x]
    if len(at) <= CHAIN:
        out = F.lit(0.0)
        for i in at:
            out = out + v[i].cast("double") * F.lit(float(q[i]))
        return out
    places, values = F.lit(at), F.lit([float(q[i]) for i in at])
    terms = F.zip_with(places, values, lambda i, x: F.get(v, i).cast("double") * x)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def unit_metric_columns(metric: str, vec, q: list[float]) -> tuple[Column, Column]:
    """As ``metric_columns``, for stored vectors of unit length (or all zeros) and a query vector by
    value: no norm is taken per row, and every metric comes from one sparse dot product but L1.
    A zero vector on either side has similarity zero (cosine, inner product)."""
    size = sum(x * x for x in q) ** 0.5
    d = sparse_dot(vec, q)
    if metric == "cosine":
        cos = d / F.lit(size) if size else F.lit(0.0)
        return F.lit(1.0) - cos, F.greatest(F.lit(0.0), cos)
    if metric == "max_inner_product":
        return -d, F.greatest(F.lit(0.0), d)
    return metric_columns(metric, vec, F.array(*[F.lit(float(x)) for x in q]))


# metric → (distance-like score where lower is nearer, similarity where higher is nearer)
def metric_columns(metric: str, vec, q) -> tuple[Column, Column]:
    if metric == "cosine":
        d = cosine_distance(vec, q)
        return d, F.greatest(F.lit(0.0), F.lit(1.0) - d)
    if metric == "L2":
        d = l2_distance(vec, q)
        return d, F.lit(1.0) / (F.lit(1.0) + d)
    if metric == "L1":
        d = l1_distance(vec, q)
        return d, F.lit(1.0) / (F.lit(1.0) + d)
    if metric == "max_inner_product":
        ip = inner_product(vec, q)
        return -ip, F.greatest(F.lit(0.0), ip)
    raise ValueError(f"unknown metric {metric!r}")

"""Distances and normalisation as Spark expressions over arrays, in double precision (K1-K8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexil.types import Metric


#: Components up to which a sum is written out: the generated code stays small enough to be compiled.
WRITTEN_OUT = 64


def _sum(a: Column, b: Column, term, size: int | None = None) -> Column:
    """Terms added from the first on; with a ``size``, which every vector must have, by compiled code instead of lambdas."""
    if size and size <= WRITTEN_OUT:
        out = F.lit(0.0)
        for i in range(size):
            out = out + term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double"))
        return out
    wide = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(wide(a), wide(b), term), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column, size: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y), size)


def inner_product(a: Column, b: Column, size: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: x * y, size)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1.0 where the product of the norms is below 1e-10."""
    scale = norm(a) * norm(b)
    return F.when(scale < 1e-10, F.lit(1.0)).otherwise(F.lit(1.0) - inner_product(a, b) / scale)


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector is an error."""
    n = norm(a)
    # the norm stands in an array of one, else it is computed for every component
    scaled = F.get(F.transform(F.array(n), lambda m: F.transform(a.cast("array<double>"), lambda x: x / m)), F.lit(0))
    return F.when(n > 0, scaled).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def distance(metric: Metric, a: Column, b: Column) -> Column:
    """What a search reports: squared L2, 1 - cos (as half the squared distance of unit vectors), or minus the product."""
    if metric == Metric.L2:
        return squared_l2(a, b)
    if metric == Metric.COSINE:
        return squared_l2(normalized(a), normalized(b)) * 0.5
    return -inner_product(a, b)

"""Vectors as arrays: products and norms in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays zero. The length is found once, as the one element of an array, not for each component."""
    length = F.array(F.greatest(norm(v), F.lit(1e-12)))
    return F.when(v.isNotNull(), F.get(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0)))

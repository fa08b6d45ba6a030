"""Vector arithmetic on array columns, in double precision, over the shorter length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term) -> Column:
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine, where both are unit vectors."""
    return _fold(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0, component by component; zeros if there are none."""
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] != 0), lambda t: t["h"])
    dims = F.sequence(F.lit(0), F.size(hidden[0]) - 1)
    total = F.transform(dims, lambda i: F.aggregate(kept, F.lit(0.0), lambda s, h: s + h[i].cast("double")))
    return F.transform(total, lambda x: F.when(F.size(kept) > 0, x / F.size(kept)).otherwise(0.0))

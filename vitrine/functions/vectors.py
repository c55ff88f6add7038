"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine import settings


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
        )
    )


def l2_normalize(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (l2_norm(a) * l2_norm(b))


def rounded(c: Column) -> Column:
    return F.round(c, settings.DIST_PLACES)

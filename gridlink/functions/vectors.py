"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def cosine01(a: Column, b: Column) -> Column:
    """The cosine moved to 0..1; 0 where it is null."""
    moved = (cosine(a, b) + 1) / 2
    return F.when(moved.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean by place of the token vectors whose mask is not 0; an error where the mask leaves none."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), kept[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(kept))
    return F.when(F.size(kept) == 0, F.raise_error(F.lit("mean_pool: all tokens are masked")).cast("array<double>")).otherwise(mean)

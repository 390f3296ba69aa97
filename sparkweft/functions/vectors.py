"""Vectors as arrays of numbers: products, cosine, normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def rounded(x: Column, places: int) -> Column:
    """A double to so many places as SQL engines do it: scaled, half away from zero, scaled back, so a
    small negative number stays a negative zero. (``F.round`` goes by decimals, which have none.)"""
    size = 10.0 ** places
    return F.when(F.abs(x) * size < 2.0 ** 52, F.signum(x) * F.floor(F.abs(x) * size + 0.5).cast("double") / size).otherwise(x)


def preview(a: Column) -> Column:
    """First four and last two components, as text, of a longer vector."""
    shown = lambda v: F.transform(v, lambda x: F.format_string("%.6f", x.cast("double")))
    return F.when(F.size(a) > 8, F.concat(shown(F.slice(a, 1, 4)), F.array(F.lit("...")), shown(F.slice(a, -2, 2)))).otherwise(shown(a))


def literal(a: Column) -> Column:
    return F.to_json(a)


def parsed(text: Column) -> Column:
    return F.from_json(text, "array<double>")

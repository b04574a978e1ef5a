"""Vector arithmetic on array columns, evaluated by the built-in higher-order functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or not a number."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & ~F.isnan(size), dot(a, b) / size)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def literal(a: Column, digits: int = 8) -> Column:
    """The text form of a vector with fixed decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def usable(a: Column, dimensions: Column) -> Column:
    """Of the right length, without null or NaN, and not all zero."""
    return a.isNotNull() & (F.size(a) == dimensions) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0)

"""Column functions on numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """The vector at length 1; components null if it is zero."""
    # in an array of one, the length is computed once a row and not for each component
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n))), 1)


def pad_to_multiple(a: Column, of: int = 8) -> Column:
    """Zeros at the end up to a length that ``of`` divides; distances don't change."""
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.pmod(-F.size(a), F.lit(of)).cast("int")))

"""Vector expressions on array columns; all stay in the JVM."""

from pyspark.sql import Column, functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, common_length: bool = False) -> Column:
    """Cosine; 0 for an empty or zero vector. Lengths that differ give 0, or with common_length the shorter one counts."""
    if common_length:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
    return F.coalesce(value, F.lit(0.0))

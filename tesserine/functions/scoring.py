"""Scores as Columns, all in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def double(c: Column) -> Column:
    return c.cast("double")


def idf(n: float, df: Column) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, dl: Column, idf_: Column, average: float, k1: float, b: float) -> Column:
    return idf_ * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / max(average, 1.0)))


def reciprocal_rank(weight: Column | float, rank: Column, k: int) -> Column:
    return double(F.lit(weight) if not isinstance(weight, Column) else weight) / (F.lit(float(k)) + rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: double(x) * double(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + double(x) * double(x)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval, clamped; null for n = 0."""
    p, z2 = double(hits) / n, Z95 * Z95
    middle, wide = p + z2 / (2 * n), Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    low, high = (middle - wide) / (1 + z2 / n), (middle + wide) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), low)), F.when(some, F.least(F.lit(1.0), high))


def wilson_sql(hits: str, n: str) -> tuple[str, str]:
    z, p = f"{Z95!r}e0", f"(CAST({hits} AS DOUBLE) / {n})"
    middle, wide = f"({p} + {z} * {z} / (2 * {n}))", f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n}))"
    under = f"(1 + {z} * {z} / {n})"
    return f"greatest(0e0, ({middle} - {wide}) / {under})", f"least(1e0, ({middle} + {wide}) / {under})"


def share(hits: Column, n: Column) -> Column:
    """hits / n, null where n is 0."""
    return F.when(n > 0, double(hits) / n)


def precision_recall_f1(answer: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Of two arrays of distinct tokens; 0 where either is empty."""
    common = double(F.size(F.array_intersect(answer, reference)))
    p = F.when(F.size(answer) > 0, common / F.size(answer)).otherwise(0.0)
    r = F.when(F.size(reference) > 0, common / F.size(reference)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

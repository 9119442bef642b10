"""Dense-vector algebra on ``array<double>`` columns with higher-order functions.

All helpers stay inside whole-stage codegen (no Python in the row path).
Vectors are ``array<double>``; float inputs are cast once on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VEC = "array<double>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return col(c).cast(VEC)


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def sq_norm(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(col(a), lambda x: x * s)


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def _with_norm(a, fn) -> Column:
    """``fn(vector, norm)`` with the norm computed once per row.

    A norm written inside a ``transform`` lambda is re-evaluated for every
    element (O(d²) per row); the finish function of ``aggregate`` binds it once.
    """
    a = col(a)
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x, lambda acc: fn(a, F.sqrt(acc)))


def l2_normalize(a, eps: float = 1e-8) -> Column:
    """``x / (||x|| + eps)``: a zero vector stays zero."""
    return _with_norm(a, lambda v, n: F.transform(v, lambda x: x / (n + F.lit(eps))))


def l2_normalize_clamped(a, eps: float = 1e-12) -> Column:
    """``x / max(||x||, eps)`` (the variant used on the training paths)."""
    return _with_norm(a, lambda v, n: F.transform(v, lambda x: x / F.greatest(n, F.lit(eps))))


def cosine(a, b) -> Column:
    """Dot product of the two L2-normalised vectors."""
    return dot(l2_normalize(a), l2_normalize(b))


def zeros(dim) -> Column:
    dim = dim if isinstance(dim, Column) else F.lit(int(dim))
    return F.transform(F.sequence(F.lit(1), dim), lambda _: F.lit(0.0))


def matvec(rows_col, v) -> Column:
    """``M v`` where ``rows_col`` is ``array<array<double>>`` (one array per output row)."""
    return F.transform(col(rows_col), lambda r: dot(r, v))


def long_form(df: DataFrame, keys: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    """``(keys..., dim bigint, value double)`` with rounding, for hash-stable comparison."""
    out = df.select(*keys, F.posexplode(col(vec)).alias("dim", "value"))
    return out.select(
        *keys,
        F.col("dim").cast("bigint").alias("dim"),
        (F.round(F.col("value").cast("double"), digits) + F.lit(0.0)).alias("value"),
    )


def round_col(c, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)

"""Dense-vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns.

Vector length is data, never a constant.  Arithmetic is done in DOUBLE.
ANSI mode is on by default, so every division is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double_array(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy; a zero vector stays zero (as scikit-learn's normalize).

    The squared norm is the accumulator of one ``aggregate`` and the division
    happens in its finish lambda, so the norm is computed once per row (a
    norm written inside ``transform`` would be re-evaluated per element).
    """
    d = as_double_array(v)
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x,
                       lambda ss: F.when(ss > 0, F.transform(d, lambda x: x / F.sqrt(ss))).otherwise(d))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))

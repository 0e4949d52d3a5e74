"""Column functions on signal values and p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Fixed values of the signal squash: exponent, knee, and the root that continues it.
POWER = 0.75
KNEE = 10.0


def _squash(v: Column) -> Column:
    return F.when(v > KNEE, 2.0 * F.sqrt(KNEE * v) - KNEE).otherwise(v)


def _unsquash(v: Column) -> Column:
    return F.when(v > KNEE, F.pow((v + KNEE) / 2.0, F.lit(2.0)) / KNEE).otherwise(v)


def scale_signal(col, mean, cap=None) -> Column:
    """Cap, divide by the track mean, raise to 0.75, squash values over 10."""
    v = _c(col).cast("double")
    if cap is not None:
        c = F.lit(float(cap)) if isinstance(cap, (int, float)) else _c(cap)
        v = F.when(c.isNull(), v).otherwise(F.least(v, c))
    m = F.lit(float(mean)) if isinstance(mean, (int, float)) else _c(mean)
    return _squash(F.pow(v / m, F.lit(POWER)))


def unscale_signal(col, mean) -> Column:
    v = _c(col).cast("double")
    v = F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)
    m = F.lit(float(mean)) if isinstance(mean, (int, float)) else _c(mean)
    return F.pow(_unsquash(v), F.lit(1.0 / POWER)) * m


def soft_clip(col, mean) -> Column:
    """Divide by the mean and squash, without the power."""
    m = F.lit(float(mean)) if isinstance(mean, (int, float)) else _c(mean)
    return _squash(_c(col).cast("double") / m)


def neglog10(col, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(_c(col), F.lit(floor)))


def positive_strand_values(value, strand) -> Column:
    """Values of minus-strand tracks, stored as negatives, as positives."""
    return F.when(_c(strand) == "-", F.abs(_c(value))).otherwise(_c(value))


def log2_fold_change(a, b) -> Column:
    """log2(b/a): +inf when only a is zero, -inf when only b is zero, 0 when neither is positive."""
    a, b = _c(a), _c(b)
    return (
        F.when((a > 0) & (b > 0), F.log2(b / a))
        .when((a == 0) & (b > 0), F.lit(float("inf")))
        .when((a > 0) & (b == 0), F.lit(float("-inf")))
        .otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))
    )


def combine_directions(p1, p2, b1, b2) -> Column:
    """Consistency p-value of the two reading directions of one position.

    The geometric mean of the p-values divided by how alike they are; 1 when the effects
    point opposite ways.
    """
    lo, hi = F.lit(1e-300), F.lit(1.0)
    x = F.least(F.greatest(_c(p1), lo), hi)
    y = F.least(F.greatest(_c(p2), lo), hi)
    alike = F.least(F.greatest(F.least(x, y) / F.greatest(x, y), F.lit(1e-12)), hi)
    p = F.when(F.signum(_c(b1)) != F.signum(_c(b2)), hi).otherwise(F.sqrt(x * y) / alike)
    return F.least(F.greatest(p, lo), hi)

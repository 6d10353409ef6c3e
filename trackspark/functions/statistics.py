"""Aggregates over pairs of columns, null where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import safe_divide


def mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def pearson(a: Column, b: Column, least: int = 2) -> Column:
    """Correlation over complete pairs; null for fewer than least pairs or a constant column."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    r = safe_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) >= least, r)


def tracking_gain(ref: Column, pred: Column) -> Column:
    """Sum of products over the sum of squares of the reference."""
    both = ref.isNotNull() & pred.isNotNull()
    return safe_divide(F.sum(F.when(both, ref * pred)), F.sum(F.when(both, ref * ref)))


def amplitude_ratio(ref: Column, pred: Column) -> Column:
    return safe_divide(F.stddev_pop(pred), F.stddev_pop(ref))


def same_sign(a: Column, b: Column) -> Column:
    """Share of rows with equal signs among those where neither is 0."""
    return F.avg(F.when((a != 0) & (b != 0), (F.signum(a) == F.signum(b)).cast("double")))

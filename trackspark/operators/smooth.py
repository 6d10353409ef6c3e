"""Exponential smoothing in blocks, with running sums only.

Values are numbered within their group and cut into blocks so long that what lies two blocks back
weighs under 1e-18. Within a block the state is a running sum of values scaled by powers of
1 - alpha; the state at the end of the block before decays into it. That equals the recursion to a
rounding, takes a constant number of steps a row, holds no group in memory and runs no Python. Missing
values are skipped without a reset and stay missing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(df: DataFrame, columns: Mapping[str, Column], alpha: float, keys: Sequence[str], order: Sequence[Column | str], whole: bool = False) -> DataFrame:
    """df with, for each of columns, state = alpha * x + (1 - alpha) * state from the group's first value
    on; needs alpha in (0, 1] and a total order. All windows share the partitioning by keys. whole: no
    column has missing values, so that all are numbered and sorted together."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    if alpha == 1:
        return df.withColumns({out: x.cast("double") for out, x in columns.items()})
    keep, size = 1 - alpha, math.ceil(math.log(1e-18) / math.log(1 - alpha))
    if whole:
        names = {out: (f"__v{k}", f"__own{k}") for k, out in enumerate(columns)}
        df = df.withColumns({"__n": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, **{names[out][0]: x.cast("double") for out, x in columns.items()}})
        place, block = F.col("__n") % size, Window.partitionBy(*keys, F.floor(F.col("__n") / size)).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
        terms = {own: F.when(F.col("__n") == 0, F.col(v) / alpha).otherwise(F.col(v)) * F.pow(F.lit(keep), -place) for v, own in names.values()}
        df = df.withColumns({own: alpha * F.pow(F.lit(keep), place) * F.sum(x).over(block) for own, x in terms.items()})
        last = {own: F.last(F.when(place == size - 1, F.col(own)), ignorenulls=True).over(before) for own in terms}
        df = df.withColumns({out: F.col(own) + F.pow(F.lit(keep), place + 1) * F.coalesce(last[own], F.lit(0.0)) for out, (_, own) in names.items()})
        return df.drop("__n", *[c for pair in names.values() for c in pair])
    for k, (out, x) in enumerate(columns.items()):
        v, n, own = f"__v{k}", f"__n{k}", f"__own{k}"
        df = df.withColumn(v, x.cast("double"))
        df = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(v).isNull(), *order)) - 1)
        place = F.col(n) % size
        term = F.when(F.col(n) == 0, F.col(v) / alpha).otherwise(F.col(v)) * F.pow(F.lit(keep), -place)
        block = Window.partitionBy(*keys, F.floor(F.col(n) / size)).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(own, alpha * F.pow(F.lit(keep), place) * F.sum(term).over(block))
        before = Window.partitionBy(*keys).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(place == size - 1, F.col(own)), ignorenulls=True).over(before)
        state = F.col(own) + F.pow(F.lit(keep), place + 1) * F.coalesce(last, F.lit(0.0))
        df = df.withColumn(out, F.when(F.col(v).isNotNull(), state)).drop(v, n, own)
    return df


def detrended(df: DataFrame, columns: Mapping[str, Column], alpha: float, keys: Sequence[str], order: Sequence[Column | str], whole: bool = False) -> DataFrame:
    """df with, for each of columns, x less its smoothed course."""
    trend = {f"__trend_{out}": x for out, x in columns.items()}
    out = smoothed(df, trend, alpha, keys, order, whole)
    return out.withColumns({name: x - F.col(f"__trend_{name}") for name, x in columns.items()}).drop(*trend)

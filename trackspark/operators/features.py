"""Order-dependent features within groups; the order must be total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


def centered(x: Column, keys: Sequence[str]) -> Column:
    """x less the group's median."""
    return x - F.median(x).over(Window.partitionBy(*keys))


def difference(x: Column, keys: Sequence[str], order: Sequence) -> Column:
    """x less the value before; null in the first row."""
    return x - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))


def shifted(x: Column, lag: int, keys: Sequence[str], order: Sequence) -> Column:
    """x of lag rows before (after, if negative); x itself where there is none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.lag(x, lag).over(w) if lag >= 0 else F.lead(x, -lag).over(w), x)


def transformed(x: Column, lag: int, sign: float, gain: float, keys: Sequence[str], order: Sequence) -> Column:
    """The shifted x, turned and stretched about the group's median."""
    anchor = F.coalesce(F.median(x).over(Window.partitionBy(*keys)), F.lit(0.0))
    return F.coalesce(anchor + sign * gain * (shifted(x, lag, keys, order) - anchor), x)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group; tasks drop the rest before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The n leading rows of each group by the order."""
    return first_rows(df, keys, order, n)


def prefix_median(x: Column, n: int, keys: Sequence[str], order: Sequence) -> Column:
    """Median of x in the first n rows of the group, on every row."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return F.median(F.when(place <= n, x)).over(Window.partitionBy(*keys))


def design(df: DataFrame, x: str, companion: str, keys: Sequence[str], order: Sequence, alpha: float = 0.28) -> DataFrame:
    """Six dynamic features of x and its companion: centred, delta, high-pass, second delta of x, and
    centred and delta of the companion. A first delta is 0."""
    from .smooth import detrended

    a, b = F.col(x), F.col(companion)
    out = df.withColumns({
        "x_centered": centered(a, keys),
        "x_delta": F.coalesce(difference(a, keys, order), F.lit(0.0)),
        "c_centered": centered(b, keys),
        "c_delta": F.coalesce(difference(b, keys, order), F.lit(0.0)),
    })
    out = detrended(out, {"x_highpass": a}, alpha, keys, order)
    return out.withColumn("x_accel", F.coalesce(difference(F.col("x_delta"), keys, order), F.lit(0.0)))


def ratios(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratio features; null where the lower part is 0."""
    return df.withColumns({name: safe_divide(F.col(a).cast("double"), F.col(b).cast("double")) for name, (a, b) in pairs.items()})

"""Row predicates and the outlier gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import tidy


def valid_strict(valid: Column, reason: Column) -> Column:
    """Flag 1 and reason "ok"; missing flags or reasons fail."""
    return (F.coalesce(valid.try_cast("int"), F.lit(0)) == 1) & (F.trim(F.coalesce(reason, F.lit("missing"))) == "ok")


def valid_lenient(reason: Column, fold_case: bool = True) -> Column:
    """Reason empty, missing or "ok"."""
    text = tidy(reason) if fold_case else F.trim(F.coalesce(reason, F.lit("")))
    return text.isin("", "ok")


def no_artifact(flag: Column) -> Column:
    return F.coalesce(flag.try_cast("int"), F.lit(0)) == 0


def near_in_time(delta_ms: Column, keys: Sequence[str], limit: float = 350.0) -> Column:
    """Time difference within the limit; a group whose differences are all missing isn't tested."""
    has_any = F.max(delta_ms.isNotNull()).over(Window.partitionBy(*keys))
    return ~has_any | F.coalesce(F.abs(delta_ms) <= limit, F.lit(False))


def mad_bounds(df: DataFrame, value: Column, keys: Sequence[str], factor: float = 3.0, least: float = 8.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """keys, center, mad, lower, upper: the median, the median distance from it, and the band of
    max(least, factor * 1.4826 * mad) about it, held within low and high. Nulls are left out."""
    rows = df.select(*keys, value.alias("__v")).where("__v is not null")
    center = rows.groupBy(*keys).agg(F.median("__v").alias("center"))
    mad = rows.join(center, list(keys)).groupBy(*keys).agg(F.first("center").alias("center"), F.median(F.abs(F.col("__v") - F.col("center"))).alias("mad"))
    band = F.greatest(F.lit(least), factor * 1.4826 * F.col("mad"))
    lower, upper = F.col("center") - band, F.col("center") + band
    lower = lower if low is None else F.greatest(lower, F.lit(low))
    upper = upper if high is None else F.least(upper, F.lit(high))
    return mad.select(*keys, "center", "mad", lower.alias("lower"), upper.alias("upper"))


def mad_gated(df: DataFrame, value: Column, keys: Sequence[str], **bounds: float) -> DataFrame:
    """df with lower, upper and inlier; bounds come from all rows given. Where a group has no value
    there are no bounds, inlier is 0, and the row passes (passes tells)."""
    out = df.join(mad_bounds(df, value, keys, **bounds).select(*keys, "lower", "upper"), list(keys), "left")
    inside = F.coalesce(value.between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.withColumns({"inlier": inside.cast("int"), "passes": inside | F.col("lower").isNull()})


def supported(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least so many rows."""
    return df.join(df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys), list(keys), "left_semi")
